"""Column expressions over texts and bytes; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.strip`` knows it, for a Java character class.
SPACE = r"\s\x1c-\x1f\x85\xa0" + "".join(chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
HANGUL = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xAC00, 0xD7A3), (0x1100, 0x11FF), (0x3130, 0x318F)))

#: Speech: characters a minute, and the least duration of a segment in seconds.
CHARS_PER_MINUTE = 750.0
LEAST_SECONDS = 0.5


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+\\z", "")


def strip(text: Column) -> Column:
    return lstrip(rstrip(text))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def estimated_seconds(content: Column) -> Column:
    """How long it takes to say: 150 words of five characters a minute, half a second at least."""
    return F.greatest(F.lit(LEAST_SECONDS), F.length(content) / F.lit(CHARS_PER_MINUTE) * F.lit(60.0))


def clock_seconds(hours: Column, minutes: Column, seconds: Column) -> Column:
    """Seconds of a time given as text; missing hours are 0."""
    number = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("long"), F.lit(0))
    return number(hours) * 3600 + number(minutes) * 60 + number(seconds)


def has_hangul(text: Column) -> Column:
    return text.rlike(f"[{HANGUL}]")


def splits_word(left: Column, right: Column) -> Column:
    """Whether a word runs on from the end of one text to the start of the other."""
    last, first = F.substring(left, -1, 1), F.substring(right, 1, 1)
    lower = last.rlike("^[a-z]$") & first.rlike("^[a-z]$")
    return lower | (last.rlike(f"^[{HANGUL}]$") & first.rlike(f"^[{HANGUL}]$"))


def joined_content(left: Column, right: Column) -> Column:
    """Two contents as one: a space between, but within a word, or where one side is blank."""
    a, b = rstrip(left), lstrip(right)
    return F.when(a == "", b).when(b == "", a).when(splits_word(a, b), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def byte_order_mark(content: Column) -> Column:
    """The encoding that a byte order mark names; null without one."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head.startswith("EFBBBF"), "utf-8-sig").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be")


def decoded(content: Column, encoding: Column) -> Column:
    """Bytes as text: UTF-8 with malformed bytes replaced, or UTF-16 of either order, its mark kept."""
    unmarked = F.when(encoding == "utf-8-sig", F.substring(content, 4, 2**31 - 1)).otherwise(content)
    plain = F.make_valid_utf8(unmarked.cast("string"))
    return F.when(encoding == "utf-16-le", F.decode(content, "UTF-16LE")).when(encoding == "utf-16-be", F.decode(content, "UTF-16BE")).otherwise(plain)


def is_valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def byte_at(content: Column, at: int | Column) -> Column:
    """A byte as a number; the position counts from 1, or back from the end if negative."""
    return F.conv(F.hex(F.substring(content, at, 1) if isinstance(at, int) else F.substr(content, at, F.lit(1))), 16, 10).cast("int")


def utf8_length(lead: Column) -> Column:
    """Bytes of the character that a byte leads; 0 for one that leads none."""
    return F.when(lead < 0x80, 1).when(lead < 0xC0, 0).when(lead < 0xE0, 2).when(lead < 0xF0, 3).when(lead < 0xF8, 4).otherwise(0)


def complete_bytes(content: Column) -> Column:
    """How many bytes from the start form whole characters: all but a character cut off at the end.

    Looks back for the last leading byte, among four bytes at most.
    """
    n = F.octet_length(content)
    out = n
    for back in (4, 3, 2, 1):
        lead = byte_at(content, -back)
        width = utf8_length(lead)
        out = F.when((n >= back) & (width > 0), F.when(width > back, n - back).otherwise(n)).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """The last suffix of a path in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
