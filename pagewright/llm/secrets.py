"""Secret scans in DataFrame functions only.

Base kinds are patterns: ``assign`` (a keyword, a sign and a value of 6 or more
characters), ``access`` (access-key ids) and ``hex`` (24 or more hexadecimal
digits).  The method adds ``enthex`` and ``entmix``: candidate strings are
maximal runs of 20 or more characters of a class (hexadecimal, or base-64 and
URL-safe base-64).  A window of 20 characters slides over the candidate; the
count of the entering character goes up, that of the leaving one down, and the
sum of c log2 c changes by these two terms alone, so every window's Shannon
entropy costs the same.  A candidate whose highest window entropy reaches the
threshold of its class is a secret unless the allow-list suppresses it or it
overlaps a span found before.  Logarithms are integers in millionths, so sums
are exact.

Positions are code points, ends exclusive.  A pattern's positions come from the
pieces between its matches, in one pass.  Candidates are looked for first; as
every ``access``, ``hex`` and ``enthex`` match lies in a candidate, texts
without one need no further scan.

Defined cases: null text is empty text; no span gives an empty string and its
digest; repeated rows are scanned each; columns named like the results are
replaced; texts are scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import table

# fixed values of the base contract
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
HEX_CANDIDATE = r"[0-9A-Fa-f]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: least window entropy in bits, by class
ENTHEX_BITS, ENTMIX_BITS = 2.85, 3.55
#: what is never a secret by entropy: no letter or no digit, a UUID, words and
#: numbers joined by one sign, one of the usual stand-ins
ALLOWED = [
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^([A-Za-z]+|[0-9]{1,8})([-_/=+]+([A-Za-z]+|[0-9]{1,8}))*$",
    r"(?i)(example|placeholder|changeme|dummy|xxxx|abcdef|123456)",
]
#: elements that an array grows by at a time, characters that are put together at a time
PART, CUT = 256, 2048
KINDS = ("assign", "access", "hex", "enthex", "entmix")
TERMS = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


def _bits(name: str, value: Column, by: Column) -> Column:
    """A shift by a column; the functions of this name take a fixed number only."""
    return F.call_function(name, value, by)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(rows: Column) -> Column:
    """An array in parts of ``PART`` elements: what grows by one element at a
    time grows within a part only."""
    count = F.greatest(F.ceil(F.size(rows) / PART).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(rows, c * PART + 1, F.lit(PART)))


def _found(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """Structs (s, k, e, v) of all matches; v is the group ``value``."""
    match = F.regexp_extract_all(text, F.lit(pattern), 0)
    group = F.regexp_extract_all(text, F.lit(pattern), value) if value else match
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("p"), match.alias("m"), group.alias("v"))
    none = F.expr("cast(array() as array<struct<s: int, k: int, e: int, v: string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["v"].alias("v"))
        # the piece after the last match has no match beside it
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    def placed(parts: Column) -> Column:
        size = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
        starts = F.aggregate(F.transform(parts, size), F.array(F.lit(0)), lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)))
        both = F.arrays_zip(parts.alias("rows"), F.slice(starts, 1, F.size(parts)).alias("at"))
        return F.flatten(F.transform(both, lambda b: F.aggregate(b["rows"], F.struct(b["at"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    return _let(rows, lambda held: _let(_parts(held), placed))


def window_entropy(value: Column, width: int = WINDOW) -> Column:
    """The least sum of c log2 c (in millionths) over all windows; the entropy
    of a window is log2(width) - sum / width, so the least sum is the highest
    entropy.  Null if ``value`` is shorter than the window.  The counts are
    five bits each, twelve to a long, so a step rewrites few cells."""
    codes = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    terms = F.array(*[F.lit(t).cast("long") for t in TERMS])
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    cells = len(ALPHABET) // 12 + 1
    start = F.struct(F.array_repeat(zero, cells).alias("n"), zero.alias("sum"), F.lit(None).cast("long").alias("least"))
    cell = lambda code: F.floor(code / 12).cast("int")
    shift = lambda code: (code % 12) * 5
    count = lambda counts, code: _bits("shiftright", F.get(counts, cell(code)), shift(code)).bitwiseAND(31).cast("int")
    steps = F.arrays_zip(codes.alias("new"), F.concat(F.array_repeat(F.lit(0), width), codes).alias("old"), F.sequence(F.lit(1), F.length(value) + width).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        gone = F.when(old > 0, count(acc["n"], old))
        moved = F.transform(acc["n"], lambda c, i: c - F.when((old > 0) & (i == cell(old)), _bits("shiftleft", one, shift(old))).otherwise(zero) + F.when(i == cell(new), _bits("shiftleft", one, shift(new))).otherwise(zero))

        def judged(counts: Column) -> Column:
            here = count(counts, new)
            total = acc["sum"] + F.coalesce(F.get(terms, gone - 1) - F.get(terms, gone), zero) + F.get(terms, here) - F.get(terms, here - 1)
            return _let(total, lambda t: F.struct(counts.alias("n"), t.alias("sum"), F.when(x["i"] >= width, F.least(acc["least"], t)).otherwise(acc["least"]).alias("least")))

        return F.when(new.isNull(), acc).otherwise(_let(moved, judged))

    return F.aggregate(steps, start, step, lambda acc: acc["least"])


def _limit(bits: float) -> int:
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1e6)


def _bounds(spans: Column) -> Column:
    """Spans in order in parts, each with the first start and the last end in it."""
    return F.transform(_parts(spans), lambda p: F.struct(F.get(p, F.lit(0))["s"].alias("s"), F.array_max(F.transform(p, lambda m: m["e"])).alias("e"), p.alias("spans")))


def _touch(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _apart(spans: Column, others: Column, keep: Callable[[Column], Column]) -> Column:
    """The spans that touch none of ``others`` (in order) and that ``keep`` holds for."""
    free = lambda m, parts: ~F.exists(parts, lambda p: _touch(p, m) & F.exists(p["spans"], lambda o: _touch(o, m)))
    return _let(_let(others, _bounds), lambda parts: F.filter(spans, lambda m: free(m, parts) & keep(m)))


def scan(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``secret_spans``: arrays of (s, k, e) by
    start, then kind; k is the place in ``KINDS``."""
    none = F.expr("cast(array() as array<struct<s: int, k: int, e: int, v: string>>)")
    text = F.coalesce(F.col(column), F.lit(""))
    out = docs.drop("base_spans", "secret_spans").withColumn("_has", text.rlike(CANDIDATE)).withColumn("_asks", text.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"))
    has = lambda pattern, kind, flag, value=0: F.when(F.col(flag), _found(text, pattern, kind, value)).otherwise(none)
    out = out.withColumn("_assign", F.filter(has(ASSIGN, 0, "_asks", 2), lambda m: F.length(m["v"]) >= ASSIGN_LEAST))
    out = out.withColumn("_base", F.array_sort(F.concat("_assign", has(ACCESS, 1, "_has"), has(HEX, 2, "_has"))))
    good = lambda m: ~F.exists(F.array(*map(F.lit, ALLOWED)), lambda p: F.regexp(m["v"], p))
    odd = lambda m, bits: window_entropy(m["v"]) <= _limit(bits)
    out = out.withColumn("_hexes", _apart(has(HEX_CANDIDATE, 3, "_has"), F.col("_base"), lambda m: good(m) & odd(m, ENTHEX_BITS)))
    out = out.withColumn("_mixed", _apart(has(CANDIDATE, 4, "_has"), F.array_sort(F.concat("_base", "_hexes")), lambda m: good(m) & odd(m, ENTMIX_BITS)))
    bare = lambda spans: F.transform(spans, lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e")))
    out = out.withColumn("base_spans", bare(F.col("_base"))).withColumn("secret_spans", bare(F.array_sort(F.concat("_base", "_hexes", "_mixed"))))
    return out.drop("_has", "_asks", "_assign", "_base", "_hexes", "_mixed")


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["k"]), m["s"], m["e"])), ",")


def redact(docs: DataFrame, column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``column`` replaced by ``mark``; spans that
    overlap become one mark, null text stays null. The text is put together
    from cuts of ``CUT`` characters, each with the spans that reach into it; a
    mark stands where its first span begins."""
    text = F.col(column)

    def cleaned(cut: Column, first: Column, spans: Column) -> Column:
        start = F.struct(first.alias("at"), F.lit("").alias("out"))
        before = lambda acc, to: F.substring(cut, acc["at"] - first + 1, to - acc["at"])

        def step(acc: Column, m: Column) -> Column:
            here = F.when(m["s"] >= acc["at"], F.concat(acc["out"], before(acc, m["s"]), F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], m["e"]).alias("at"), here.alias("out"))

        return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.when(acc["at"] < first + CUT, F.substring(cut, acc["at"] - first + 1, F.lit(CUT))).otherwise("")))

    def joined(parts: Column) -> Column:
        def one(cut: Column, i: Column) -> Column:
            here = F.struct((i * CUT).alias("s"), (i * CUT + CUT).alias("e"))
            near = F.flatten(F.transform(F.filter(parts, lambda p: _touch(p, here)), lambda p: F.filter(p["spans"], lambda m: _touch(m, here))))
            return cleaned(cut, i * CUT, near)

        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), 0), one), "")

    clean = _let(_let(F.col("secret_spans"), _bounds), joined)
    return scan(docs, column).withColumn(column, F.when(F.size("secret_spans") > 0, clean).otherwise(text)).drop("base_spans", "secret_spans")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda m: m["k"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spelled(F.col("base_spans")), 256).alias("base_sha256"),
        spelled(F.col("secret_spans")).alias("spans"),
    )


def _oracle() -> str:
    def spans(kind: int, pattern: str, of: str, where: str = "true") -> str:
        return f"""
        SELECT doc_id, {kind} AS k, s, s + length(m) AS e, m FROM (
          SELECT doc_id, m[i] AS m, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT
                 + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS s
          FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM {of})))
        WHERE {where}"""

    assign = ASSIGN.replace("'", "''")
    value = "length(regexp_extract(m, '" + assign + f"', 2)) >= {ASSIGN_LEAST}"
    terms = "[" + ", ".join(f"{t}" for t in TERMS) + "]"
    allowed = " AND ".join(f"NOT regexp_matches(m, '{p}')" for p in ALLOWED)
    kinds = "['" + "', '".join(KINDS) + "']"

    def odd(source: str, bits: float) -> str:
        return f"""
        SELECT doc_id, k, s, e FROM (
          SELECT doc_id, k, s, e, list_sum(list_transform(list_distinct(w), lambda c: ({terms})[len(list_filter(w, lambda d: d = c)) + 1])) AS total
          FROM (SELECT doc_id, k, s, e, string_split(substring(m, i, {WINDOW}), '') AS w
                FROM (SELECT *, unnest(range(1, length(m) - {WINDOW} + 2)) AS i FROM {source} WHERE {allowed})))
        GROUP BY doc_id, k, s, e HAVING min(total) <= {_limit(bits)}"""

    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    base AS (SELECT doc_id, k, s, e FROM ({spans(0, assign, "d", value)} UNION ALL {spans(1, ACCESS, "d")} UNION ALL {spans(2, HEX, "d")})),
    h AS ({spans(3, HEX_CANDIDATE, "d")}),
    h1 AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.s < h.e AND h.s < b.e)),
    hexes AS ({odd("h1", ENTHEX_BITS)}),
    c AS ({spans(4, CANDIDATE, "d")}),
    c1 AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM base UNION ALL SELECT * FROM hexes) b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
    mixed AS ({odd("c1", ENTMIX_BITS)}),
    b AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
            string_agg(({kinds})[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS j FROM base GROUP BY doc_id),
    a AS (SELECT doc_id, string_agg(({kinds})[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS j
          FROM (SELECT * FROM base UNION ALL SELECT * FROM hexes UNION ALL SELECT * FROM mixed) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
           sha256(coalesce(b.j, '')) AS base_sha256, coalesce(a.j, '') AS spans
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
    """


OP1_SQL = _oracle()
