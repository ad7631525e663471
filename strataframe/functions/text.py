"""Text functions: names, identifiers, tokens, redaction."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without meaning of their own in reports; fixed values.
STOP_WORDS = (
    "a an and are as at be been but by can do for from had has have he her his in into is it its of on or our she that the their them there these they this to was were what when where which who will with would you your "
    "document page report table figure source data appendix contents section following mining department government annual year years india row rows column columns header headers qty during last first second third fourth fifth "
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty wise total type"
).split()


@cache
def _folding(form: str, lower: bool) -> tuple[str, str, dict[str, str], str]:
    """How characters beyond ASCII come out of a Unicode normal form as ASCII: those that give one character and what they
    give, those that give several, and a pattern of ASCII characters that the form joins with a mark behind them."""
    one, many = {}, {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x1FC00)]:
        c = chr(code)
        got = unicodedata.normalize(form, c)
        got = "".join(x for x in (got.casefold() if lower else got) if x.isascii())
        if len(got) == 1:
            one[c] = got
        elif got:
            many[c] = got
    marks = {}
    for m in map(chr, range(0x300, 0x370)):
        own = "".join(c for c in string.ascii_letters if len(unicodedata.normalize("NFC", c + m)) == 1)
        if own:
            marks.setdefault(own, []).append(m)
    joined = "|".join(f"[{own}][{''.join(ms)}]" for own, ms in marks.items()) if form == "NFKC" else ""
    return "".join(one), "".join(one.values()), many, joined


def _one_of(chars: Iterable[str]) -> str:
    """A pattern of the characters, all beyond ASCII, as ranges. A class is compared range by range, so ASCII is told apart before."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return r"(?![\x00-\x7F])[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def _spelt(text: Column, many: dict[str, str]) -> Column:
    """``text`` with the characters of ``many`` replaced by what they give; each different one once."""
    known = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_one_of(many)), F.lit(0)))
    return F.aggregate(found, text, lambda t, c: F.replace(t, c, F.element_at(known, c)))


def _beyond_ascii(text: Column, folded: Column) -> Column:
    """``folded`` of texts with characters beyond ASCII; others are as they are."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)


def _folded(text: Column, form: str, lower: bool) -> Column:
    one, plain, many, joined = _folding(form, lower)
    own = F.regexp_replace(text, joined, "") if joined else text
    return _beyond_ascii(text, F.regexp_replace(F.translate(_spelt(own, many), one, plain), r"[^\x00-\x7F]", ""))


def fold_ascii(text: Column) -> Column:
    """Characters taken apart by compatibility (NFKD) and all that is not ASCII dropped: accents go, ligatures and full-width letters are spelt."""
    return _folded(text, "NFKD", False)


def entity_key(name: Column) -> Column:
    """Letters and digits in lower case, accents off: equal keys are one name."""
    return F.regexp_replace(F.lower(fold_ascii(name)), "[^a-z0-9]+", "")


@cache
def _case_folding() -> tuple[str, str, dict[str, str]]:
    """Characters that are in lower case and yet not folded: those folded to one character and to what, and those folded to several."""
    folded = {c: c.casefold() for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x1FC00)]) if c.lower() == c != c.casefold()}
    one = {c: f for c, f in folded.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in folded.items() if len(f) > 1}


def case_fold(text: Column) -> Column:
    """Text for comparison without case: as in lower case, but ``ß`` is ``ss``, ligatures are spelt and a final sigma is a sigma."""
    one, plain, many = _case_folding()
    low = F.lower(text)
    return _beyond_ascii(low, F.translate(_spelt(low, many), one, plain))  # what is folded does not change when folded again


def name_key(name: Column) -> Column:
    """As :func:`entity_key`, but case is folded and accented letters are dropped."""
    return F.regexp_replace(case_fold(name), "[^a-z0-9]+", "")


def mention_key(name: Column) -> Column:
    """As :func:`name_key` after joining by compatibility (NFKC): full-width letters and ligatures count, accented letters do not."""
    return F.regexp_replace(F.lower(_folded(name, "NFKC", True)), "[^a-z0-9]+", "")


def safe_filename(name: Column) -> Column:
    """The last part of a path: its stem without accents and unusual characters, 160 characters at most and ``document`` if none is left, and its extension in lower case."""
    leaf = F.regexp_extract(F.translate(name, "\\", "/"), r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(leaf, r"(?s)^.+(\.[^.]+)$", 1))
    ends = r"^[._-]+|[._-]+$"
    clean = F.regexp_replace(F.regexp_replace(fold_ascii(leaf), r"[^A-Za-z0-9._-]+", "_"), ends, "")
    stem = F.substring(F.regexp_replace(F.regexp_replace(clean, r"\.[^.]+$", ""), ends, ""), 1, 160)
    return F.concat(F.when(stem == "", "document").otherwise(stem), extension)


def uuid5(namespace: Column, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace (a UUID's text), equal to every other implementation's."""
    h = F.sha1(F.concat(F.unhex(F.regexp_replace(namespace, "-", "")), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


# What readers are not shown.
_UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
_FIELD = r"(?i)\b(?:source_document_id|source_version_id|source_page_id|source_content_id|source_table_id|source_cell_id|source_candidate_id|verification_id|verifier_id|record_id|chunk_id|document_id|document_version_id|page_id)\b"


def redact(text: Column) -> Column:
    """Identifiers and internal field names taken out of text for readers."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _UUID, ""), _FIELD, ""), r"[ \t]{2,}", " "))


def safe_narrative(text: Column) -> Column:
    """The text, or nothing if it holds an identifier or an internal field name."""
    return F.when(text.rlike(_UUID) | text.rlike(_FIELD), "").otherwise(text)


def formula_safe(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


#: What a token is, and tokens that mean nothing.
TOKEN = r"[a-z][a-z0-9-]+"
NOISE = r"[a-z]{1,2}|[0-9]+|[a-f0-9]{12,}"


def tokens(text: Column) -> Column:
    """Words of a letter and more letters, digits or hyphens, in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def meaningful(token: Column) -> Column:
    """Neither a stop word, nor one or two letters, nor a long hexadecimal number."""
    return ~token.isin(STOP_WORDS) & ~token.rlike(f"^(?:{NOISE})$")


def terms(text: Column) -> Column:
    """Meaningful tokens, and pairs of different meaningful tokens that stand side by side in the text."""
    every = tokens(text)
    pairs = F.zip_with(F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(0))), F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0))), lambda a, b: F.when((a != b) & meaningful(a) & meaningful(b), F.concat(a, F.lit(" "), b)))
    return F.concat(F.filter(every, meaningful), F.array_compact(pairs))
