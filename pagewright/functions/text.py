"""Column functions on text: lines, whitespace, snippets, previews, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the line ends of universal newlines
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: what a regular expression calls white space, Unicode included
SPACE = r"(?U)[\s\u001c-\u001f]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(text: Column | str) -> Column:
    """Lines of a text; the empty line after a last line end is none (H4)."""
    text = col(text)
    # most texts have line feeds only, and splitting at one character is far faster
    parts = F.when(text.rlike(LINE_ENDS.replace("\r\n|[\n", "[")), F.split(text, LINE_ENDS, -1)).otherwise(F.split(text, "\n", -1))
    return once(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def strip(text: Column | str) -> Column:
    """White space of any kind off both ends (H5)."""
    return F.regexp_replace(col(text), f"^{SPACE}+|{SPACE}+$".replace("$", r"\z"), "")


def collapse_blank(text: Column | str) -> Column:
    """Runs of three or more line feeds become two (H6)."""
    return F.regexp_replace(col(text), "\n{3,}", "\n\n")


def literal_pattern(text: str) -> str:
    """A case-insensitive pattern for just this text (B1, H1)."""
    return "(?iu)" + "".join(f"\\Q{part}\\E" if part else "" for part in _between(text))


def _between(text: str) -> list[str]:
    """Pieces that can stand in a quoted span; a quote end is split in two."""
    out, rest = [], text
    while "\\E" in rest:
        at = rest.index("\\E") + 1
        out.append(rest[:at])
        rest = rest[at:]
    return [*out, rest]


def regex_pattern(pattern: str) -> str:
    """A Python-style pattern in the engine's dialect: case-insensitive, Unicode
    classes, named groups respelled (B2). Invalid patterns raise ValueError now
    and not within a stage."""
    import re

    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'U95')}>", pattern)
    return "(?iuU)" + re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m[1].replace('_', 'U95')}>", pattern)


def snippet(line: Column | str, pattern: str | Column, each_side: int = 200) -> Column:
    """The first match with up to ``each_side`` characters around it; an ellipsis
    marks a cut end (H2, H3). Positions are code points."""
    line = col(line)
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    found = F.regexp_substr(line, pattern)
    # what stands before the first match: cut at the (UTF-16) place of the match
    before = F.length(F.get(F.split(line, pattern, 2), F.lit(0)))
    # a match at the very start leaves an empty first piece; an empty match has length 0
    start = F.when(F.length(found) == 0, F.lit(0)).otherwise(before)
    end = start + F.length(found)
    left, right = F.greatest(start - each_side, F.lit(0)), F.least(end + each_side, F.length(line))
    return F.concat(F.when(left > 0, "…").otherwise(""), F.substring(line, left + 1, right - left), F.when(right < F.length(line), "…").otherwise(""))


def preview(text: Column | str, limit: int = 500) -> Column:
    """The first ``limit`` characters, and how many more there are (F9, H13); null is empty."""
    text = F.coalesce(col(text), F.lit(""))
    more = F.length(text) - limit
    return F.when(more <= 0, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("… (truncated, "), more.cast("string"), F.lit(" more chars)")))


def token_count(text: Column | str) -> Column:
    """Tokens by the ratio of four characters to one (H11), for where no
    vocabulary is at hand; ``tokens.counter`` counts by one."""
    return F.ceil(F.length(col(text)) / 4).cast("int")


def truncated_note(limit: int) -> str:
    return f"\n\n[truncated at ~{limit} tokens]"


def token_truncate(text: Column | str, limit: int = 8000) -> Column:
    """At most ``limit`` tokens by the same ratio, with a notice (F7, H12);
    ``tokens.truncater`` does so by a vocabulary."""
    text = col(text)
    return F.when(F.length(text) <= limit * 4, text).otherwise(F.concat(F.substring(text, 1, limit * 4), F.lit(truncated_note(limit))))


def segment_id(ordinal: Column | str) -> Column:
    """s_000, s_001, ...; wider from 1000 on."""
    return F.format_string("s_%03d", col(ordinal))


def file_stem(path: Column | str) -> Column:
    """File name without folders and last extension."""
    name = F.regexp_extract(col(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def message_text(blocks: Column | str, joint: str = "\n") -> Column:
    """Text of message blocks (array of strings) joined."""
    return F.array_join(F.filter(col(blocks), lambda b: b.isNotNull() & (b != "")), joint)


def thousands(number: Column | str) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(col(number), 0)


def decoded_list(text: Column | str, element: str = "string") -> Column:
    """A list written as JSON in a string; null if it is none."""
    text = col(text)
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, f"array<{element}>"))


def iso_utc(at: Column | str) -> Column:
    """A time as ISO 8601 in UTC, to the microsecond."""
    return F.date_format(F.to_utc_timestamp(col(at).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def clamp(number: Column | str, low: int, high: int) -> Column:
    """``number`` moved into the range."""
    return F.greatest(F.lit(low), F.least(col(number), F.lit(high)))


def usage(payload: Column | str) -> Column:
    """Token counts of a model result in either of two shapes."""
    read = lambda path: F.try_variant_get(F.try_parse_json(col(payload)), path, "int")
    new = F.struct(*(F.coalesce(read(f"$.{name}_tokens"), F.lit(0)).alias(name) for name in ("input", "output", "total")))
    prompt, completion = (F.coalesce(read(f"$.{name}_tokens"), F.lit(0)) for name in ("prompt", "completion"))
    total = read("$.total_tokens")
    old = F.struct(prompt.alias("input"), completion.alias("output"), F.when(F.coalesce(total, F.lit(0)) != 0, total).otherwise(prompt + completion).alias("total"))
    has_new = F.coalesce(read("$.input_tokens"), read("$.output_tokens")).isNotNull()
    has_old = F.coalesce(read("$.prompt_tokens"), read("$.completion_tokens"), total).isNotNull()
    none = F.struct(F.lit(0).alias("input"), F.lit(0).alias("output"), F.lit(0).alias("total"))
    return F.when(has_new, new).when(has_old, old).otherwise(none)
