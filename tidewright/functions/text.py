"""Column functions over text, names and times; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that may not appear in file names.
ESCAPED = r'[/?%*:|<>".$…, ]'
MAX_ID = 4294967295
#: Voice names that differ from their language codes.
VOICES = {"br": "pt", "cz": "cs", "esmx": "es-la", "kr": "ko"}
#: Duration per phoneme by phoneme count (at most, milliseconds), and beyond.
DURATIONS, LEAST_DURATION = [(20, 100), (50, 80), (75, 75)], 73


def strip_hints(text: Column) -> Column:
    """Text without *stage hints*."""
    return F.regexp_replace(text, r"\*[^*]+\*", "")


def escape_textline(text: Column) -> Column:
    """Text as part of a file name: special characters become _; the first 50 characters."""
    return F.left(F.regexp_replace(text, ESCAPED, "_"), F.lit(50))


def capitalize(text: Column) -> Column:
    """Upper case for the first character of each word, the rest as it is."""
    return F.array_join(F.transform(F.split(F.trim(text), " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def voiceover_actor(name: Column) -> Column:
    """The actor in a voice-over name: without its last two _ parts, upper case; null if empty."""
    cut = F.upper(F.trim(F.regexp_replace(name, "(_[^_]*){1,2}$", "")))
    return F.when(cut != "", cut)


def clean_text(text: Column, chars: str) -> Column:
    """Lower case, with clean-up characters as spaces."""
    return F.translate(F.lower(text), chars, " " * len(chars))


def tokens(text: Column) -> Column:
    """The non-empty words of a text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def consecutive_dedup(text: Column) -> Column:
    return F.regexp_replace(text, r"(.)\1+", "$1")


def decode_text(text: Column) -> Column:
    """Doubled quotes become one; white space and quotes around are cut."""
    inner = F.btrim(F.replace(text, F.lit('""'), F.lit("|")), F.lit(' \t\r\n"'))
    return F.replace(inner, F.lit("|"), F.lit('"'))


def stem(name: Column) -> Column:
    """A file name without its last extension; null without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", ""))


def file_id(name: Column) -> Column:
    """The id in a file name: digits at its start (ten at most), else at its end, else all of it; within 32 bits."""
    return id_of_stem(stem(name))


def id_of_stem(s: Column) -> Column:
    """The id in a file name without its extension."""
    whole = F.when(s.rlike(r"^[+]?[0-9]{1,19}$"), s)
    found = F.array(*(x.try_cast("bigint") for x in (F.regexp_extract(s, "^([0-9]{1,10})", 1), F.regexp_extract(s, "([0-9]{1,10})$", 1), whole)))
    # The first that fits; as a list, each pattern stands in the plan once.
    return F.get(F.filter(found, lambda x: x <= MAX_ID), 0)


def file_duration(name: Column) -> Column:
    """The seconds between the first [ and the next ] of a file name."""
    return F.regexp_extract(stem(name), r"\[([^\]]*)", 1).try_cast("float")


def file_kind(name: Column, id_: Column | None = None) -> Column:
    """audio, unlinked or phonemes; null for other files.  The name's id may be given, if it is at hand."""
    has = (file_id(name) if id_ is None else id_).isNotNull()
    audio = F.endswith(name, F.lit(".wav")) | F.endswith(name, F.lit(".ogg"))
    return F.when(audio & has, "audio").when(audio, "unlinked").when(F.endswith(name, F.lit(".phonemes")) & has, "phonemes")


def rename_target(line_id: Column, duration: Column, actor: Column, text: Column, name: Column, full: Column | None = None) -> Column:
    """The new name of an audio file: the id in ten digits, the duration, the actor between dashes, and the line's text with
    the old ending; where the renaming is not full, the old name without its leading digits in place of the text."""
    who = F.coalesce(escape_textline(F.concat(F.lit("-"), actor, F.lit("-"))), F.lit(""))
    seconds = F.when(duration.isNotNull(), F.format_string("[%.4f]", duration.cast("double"))).otherwise("")
    ending = F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)
    rest = F.concat(escape_textline(text), F.lit("."), ending)
    if full is not None:
        rest = F.when(full, rest).otherwise(drop_leading_digits(name))
    return F.concat(F.lpad(line_id.cast("string"), 10, "0"), seconds, who, rest)


def drop_leading_digits(name: Column) -> Column:
    return F.regexp_replace(name, "^[0-9]+", "")


def directory_language(name: Column) -> Column:
    """The language in a directory name: speech.<ll>.* or <ll>.*"""
    found = F.regexp_extract(F.lower(name), r"^(?:speech\.)?([^.]{2})\.", 1)
    return F.when(found != "", found)


def snap_ms(time: Column, step: int, low: Column, high: Column) -> Column:
    """Rounded half away from zero to a multiple of step, then clamped; the lower bound wins."""
    t = F.round(time / step) * step
    return F.when(t < low, low).when(t > high, high).otherwise(t).cast("bigint")


def meta_key(line: Column) -> Column:
    return F.regexp_extract(line, r"^;meta\[([^=]*)=(.*)\]$", 1)


def meta_value(line: Column) -> Column:
    return F.regexp_extract(line, r"^;meta\[([^=]*)=(.*)\]$", 2)


def header_value(line: Column) -> Column:
    """The value of an old-style header line: after the first colon, without quotes."""
    return F.btrim(F.regexp_extract(line, "^[^:]*:(.*)$", 1), F.lit(' "'))


def search_preset(stem_: Column) -> Column:
    return F.translate(F.left(stem_, F.lit(10)), "._", "  ")


def ellipsis(name: Column, most: int = 70) -> Column:
    """Cut after most characters where the name has more than most bytes."""
    return F.when(F.octet_length(name) > most, F.concat(F.left(name, F.lit(most)), F.lit("..."))).otherwise(name)


def voice(language: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in VOICES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, language), language)


def phoneme_weight(raw: Column) -> Column:
    """Weight by stress sign; the signs are tested in this order."""
    return F.when(F.contains(raw, F.lit('"')), 1.15).when(F.contains(raw, F.lit("ˌ")), 1.05).when(F.contains(raw, F.lit("ˈ")), 1.1).otherwise(1.0)


def phoneme_duration(raw: Column, slot: Column) -> Column:
    """Milliseconds: doubled by ː, a quarter for -."""
    return F.when(F.contains(raw, F.lit("ː")), slot * 2).when(F.contains(raw, F.lit("-")), F.floor(slot / 4)).otherwise(slot).cast("bigint")


def strip_stress(raw: Column) -> Column:
    return F.translate(raw, '"ˌˈ', "")


def slot_duration(n: Column) -> Column:
    """Milliseconds per phoneme by their number."""
    out = F.when(n <= DURATIONS[0][0], DURATIONS[0][1])
    for most, ms in DURATIONS[1:]:
        out = out.when(n <= most, ms)
    return out.otherwise(LEAST_DURATION).cast("bigint")


def lead_padding(n: Column) -> Column:
    return F.greatest(F.lit(75), 1000 - n * slot_duration(n)).cast("bigint")


def ipa_separated(raw: Column) -> Column:
    """Translator output: (lang) tags cut, combining modifiers joined to their phoneme, one _ between phonemes."""
    x = F.regexp_replace(raw, r"\([^)]*\)", "")
    x = F.regexp_replace(x, "_+(?=[ːʲʰ̃])", "")
    return F.regexp_replace(F.regexp_replace(x, "_{2,}", "_"), "(^|(?<= ))_|_($|(?= ))", "")


def grammar(words: Column) -> Column:
    """A recognizer grammar line of pronunciations, with optional silence between them."""
    body = F.concat(F.lit("[SIL] "), F.array_join(words, " [ SIL+ ] "), F.lit(" [SIL]"))
    return F.concat(F.lit("#JSGF V1.0;\ngrammar line;\npublic <line> = "), F.replace(body, F.lit("  "), F.lit(" ")), F.lit(";"))


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))


def valid(value: Column, *, nonempty: bool = False, ascii_only: bool = False, least: int | None = None, most: int | None = None, chars: str | None = None) -> Column:
    """Field checks; a least length lets the empty value pass."""
    out = F.lit(True)
    if nonempty:
        out &= value != ""
    if ascii_only:
        out &= value.rlike(r"^\p{ASCII}*$")
    if least is not None:
        out &= (F.length(value) >= least) | (value == "")
    if most is not None:
        out &= F.length(value) <= most
    if chars is not None:
        out &= value.rlike(f"^(?:{chars})*$")
    return out


def is_clock(value: Column, seconds: bool = False) -> Column:
    """HH:mm, with hours below 24; or HH:mm:ss, whose hours are not checked."""
    return value.rlike(r"^[0-9]{2}:[0-5][0-9]:[0-5][0-9]$" if seconds else r"^([01][0-9]|2[0-3]):[0-5][0-9]$")


def replacement_token(word: Column) -> Column:
    """A replacement's phonemes joined by _: hyphens become _, else one follows each sign but stress signs and what ː lengthens."""
    spread = F.replace(F.regexp_replace(word, '([^ˈ"ˌ])', "$1_"), F.lit("_ː"), F.lit("ː"))
    return F.btrim(F.when(F.contains(word, F.lit("-")), F.replace(word, F.lit("-"), F.lit("_"))).otherwise(spread), F.lit("_"))


def phoneme_tokens(translated: Column) -> Column:
    """Structs (phoneme, word_start) of a translation: words by spaces, phonemes by _, empty ones left out."""
    words = F.filter(F.transform(F.split(translated, " "), lambda w: F.filter(F.split(w, "_"), lambda p: p != "")), lambda w: F.size(w) > 0)
    return F.flatten(F.transform(words, lambda w: F.transform(w, lambda p, i: F.struct(p.alias("phoneme"), (i == 0).alias("word_start")))))


def phoneme_count(translated: Column) -> Column:
    """Phonemes that the duration of generated audio follows: parts between spaces and _, empty ones counted too."""
    return F.size(F.split(F.translate(translated, "_", " "), " ", -1)).cast("bigint")


def letters_to_say(word: Column) -> Column:
    """The letters of a word without pronunciation: without apostrophes, of equal neighbours one."""
    plain = F.replace(word, F.lit("'"), F.lit(""))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(plain, r"(?s)(.)\1+", "$1"), "(?!^)(?!$)"))


def log_multiply(a: Column, b: Column) -> Column:
    """log(exp(a) * exp(b))."""
    return a + b


def log_to_base(x: Column, base: float) -> Column:
    """A natural logarithm in another base."""
    return x / F.log(F.lit(base))


def log_from_base(x: Column, base: float) -> Column:
    return x * F.log(F.lit(base))
