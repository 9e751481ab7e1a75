"""Secret scanning with multipart credential linking, in DataFrame and SQL functions only.

Strong patterns are reported wherever they stand. Weak parts (short secrets, bare keys, short access
identifiers, addresses) mean nothing alone: they are reported only where a complementary part, an access
identifier or address for a secret and a secret for the others, starts within the same scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.llm.scratch import cut

_letters = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = "|".join((_letters("password"), _letters("passwd"), _letters("secret"), _letters("token"), _letters("api") + "_?" + _letters("key")))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run of these letters, as a whole
BARE = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_.=-])"
ADDRESS = r"[A-Za-z][A-Za-z0-9+]*://[^\x20\x09-\x0D\"'<>]+"
#: Kinds in the order in which spans that start together are listed, and the role of each as a part.
KINDS = ("assign", "access", "hex", "weak_secret", "bare_key", "weak_access", "endpoint")
ROLES = {"assign": "secret", "weak_secret": "secret", "bare_key": "secret", "access": "access", "weak_access": "access", "endpoint": "endpoint"}
BASE = KINDS[:3]
ASSIGN_LETTERS, ACCESS_LETTERS, WEAK_LETTERS = 12, 18, 4
#: Parts are complementary if they start at most this many code points apart.
SCOPE = 200

_SPAN = "STRUCT<start: INT, rank: INT, end: INT>"


def _pieces(name: str, rank: str) -> Column:
    """The matches of a pattern: their number, the length of the text before each and its own, and its rank, an
    SQL expression of the match `m` and its number `i` that is null where the match doesn't count."""
    one = f"named_struct('pattern', '{name}', 'i', i, 'gap', char_length({name}_g[i]), 'length', char_length(m), 'rank', CAST({rank} AS INT))"
    return F.expr(f"coalesce(transform({name}_m, (m, i) -> {one}), array())")


def _matches(df: DataFrame, name: str, pattern: str, where: Column, group: int | None = None) -> DataFrame:
    """Adds <name>_m, the pattern's matches, <name>_g, the text between them, and <name>_v, one group of each;
    null where the condition doesn't hold, so that most texts are searched once."""
    out = {f"{name}_m": F.when(where, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), f"{name}_g": F.when(where, F.split("text", pattern, -1))}
    if group is not None:
        out[f"{name}_v"] = F.when(where, F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))
    return df.withColumns(out)


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, pieces): the matches of every row's text; rank is a position in KINDS. Weak parts are looked
    for only where parts of two roles can be present. Rows that are wholly alike share the key, 128 bits."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("key", F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").cast("binary"))))
    has = {"assign": F.col("text").rlike(ASSIGN), "access": F.col("text").contains("AKIA"), "hex": F.col("text").rlike(HEX), "endpoint": F.col("text").contains("://")}
    df = df.withColumns({f"has_{k}": c for k, c in has.items()})
    df = _matches(df, "assign", ASSIGN, F.col("has_assign"), 2)
    df = _matches(df, "access", ACCESS, F.col("has_access"))
    df = _matches(df, "hex", HEX, F.col("has_hex"))
    other = F.col("has_access") | F.col("has_endpoint")
    df = _matches(df, "bare", BARE, other)
    df = _matches(df, "endpoint", ADDRESS, F.col("has_endpoint") & (F.col("has_assign") | (F.size("bare_m") > 0)))
    rank = {k: i for i, k in enumerate(KINDS)}
    pieces = F.concat(
        _pieces("assign", f"CASE WHEN char_length(assign_v[i]) >= {ASSIGN_LETTERS} THEN {rank['assign']} WHEN char_length(assign_v[i]) >= {WEAK_LETTERS} THEN {rank['weak_secret']} END"),
        _pieces("access", f"CASE WHEN char_length(m) >= {ACCESS_LETTERS} THEN {rank['access']} WHEN char_length(m) >= {len('AKIA') + WEAK_LETTERS} THEN {rank['weak_access']} END"),
        _pieces("hex", str(rank["hex"])), _pieces("bare", str(rank["bare_key"])), _pieces("endpoint", str(rank["endpoint"])),
    )
    return df.select("doc_id", "key", pieces.alias("pieces"))


def placed(found: DataFrame) -> DataFrame:
    """(key, s): the spans {start, rank, end} of each distinct row, placed by running sums of lengths."""
    rows = found.filter(F.size("pieces") > 0).dropDuplicates(["key"]).select("key", F.inline("pieces"))
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("key", "pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("end", end).filter("rank IS NOT NULL")
    return rows.select("key", F.struct((F.col("end") - F.col("length")).alias("start"), "rank", "end").alias("s"))


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, s): the strong spans, and the weak parts that a complementary part backs and no strong span covers.

    An interval join of the parts of a text, as sliding windows over their starts: no pairs are made."""
    is_role = lambda role: F.array_contains(F.lit([i for i, k in enumerate(KINDS) if ROLES.get(k) == role]), F.col("s.rank"))
    strong = F.col("s.rank") < len(BASE)
    near = Window.partitionBy("key").orderBy("s.start").rangeBetween(-scope, scope)
    count = {r: F.count(F.when(is_role(r), 1)).over(near) for r in ("secret", "access", "endpoint")}
    before = F.max(F.when(strong, F.col("s.end"))).over(Window.partitionBy("key").orderBy("s.start").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(strong, F.col("s.start"))).over(Window.partitionBy("key").orderBy(F.desc("s.start")).rangeBetween(Window.unboundedPreceding, 0))  # the mirrored frame adds up; the other one starts anew at each row
    rows = spans.select("key", "s", *[c.alias(r) for r, c in count.items()], before.alias("before"), after.alias("after"))
    backed = F.when(is_role("secret"), (F.col("access") > 0) | (F.col("endpoint") > 0)).otherwise(F.col("secret") > 0)
    free = (F.coalesce("before", F.lit(0)) <= F.col("s.start")) & (F.coalesce("after", F.col("s.end")) >= F.col("s.end"))
    return rows.filter(strong | (backed & free)).select("key", "s")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, spans) for each row of docs (doc_id, text): the strong spans and all reported spans, as
    arrays of {start, rank, end} in order; positions count code points, the end is exclusive.

    Null and empty texts have none; texts of any length are searched whole. Rows that are wholly alike get the
    same. Spans that start together are ordered by kind. An empty table gives an empty one; other columns are not
    read."""
    found = cut(parts(docs))  # lengths only; both uses read them back
    spans = linked(placed(found), scope).groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    out = found.select("doc_id", "key").join(spans, "key", "left")
    out = out.select("doc_id", F.coalesce("spans", F.expr(f"CAST(array() AS ARRAY<{_SPAN}>)")).alias("spans"))
    return out.select("doc_id", F.filter("spans", lambda s: s.rank < len(BASE)).alias("base"), "spans")


def listing(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.lit(list(KINDS)), s.rank + 1), s.start, s.end)), ",")
