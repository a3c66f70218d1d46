"""Timed-sequence analytics and corpus preparation on PySpark.

The public names below are loaded when they are first used, so that importing one module stays cheap for workers.
"""

from importlib import import_module

#: Public name -> module.
_PUBLIC = {
    "load_audio": "api",
    "register_decoder": "api",
    "find_missing_audio": "api",
    "generate": "api",
    "extract": "api",
    "process": "api",
    "result_events": "api",
    "language_settings": "api",
    "search_strings_file": "api",
    "search_actor_mappings_file": "api",
    "refresh_phoneme_dictionary": "api",
    "console_logging": "api",
    "align_tracks": "operators.align",
    "Similarity": "operators.align",
    "n_best_tracks": "operators.nbest",
    "close_gaps": "operators.gaps",
    "track_quality": "operators.tracks",
    "task_queue": "operators.catalog",
    "numbered": "operators.ordinals",
    "line_catalogue": "sources.readers",
    "similarity_matrix": "sources.readers",
    "actor_mappings": "sources.readers",
    "track_files": "sources.sinks",
    "register_formats": "sources.formats:register",
    "run_queue": "streaming.queue",
    "task_states": "streaming.queue",
    "speech_events": "streaming.endpoints",
}

__all__ = sorted(_PUBLIC)


def __getattr__(name: str) -> object:
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, _, attribute = _PUBLIC[name].partition(":")
    return getattr(import_module(f".{module}", __name__), attribute or name)
