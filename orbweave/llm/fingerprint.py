"""Homomorphic multiset fingerprints, with DataFrame functions alone.

A text is the multiset of its paragraphs (lines). A paragraph's vector has

* 17 numbers of 60 bits from SHA-256 hashes, added modulo 2**60: they tell
  multisets apart;
* 120 one-bit counters from the MD5 of each of its runs of up to four words,
  two of 30 bits to a number, added modulo 2**60, and the number of runs (at most
  2**30, as a string has at most 2**31 bytes, so no counter overflows): a
  counter's distance from half of the runs is a random +-1 projection of the
  multiset of runs, so products of two texts' projections estimate how much they
  share.

A text's fingerprint is its paragraphs' sum: their order doesn't matter, and
``add`` and ``subtract`` insert and delete paragraphs without the rest.

Defined results: a null text is the empty text, which has one empty paragraph.
Equal texts have equal fingerprints; likeness of a fingerprint to itself is 1,
of two without words 1 or 0. Rows of one doc_id follow each other in order of
text; a null doc_id comes last. An empty table gives no rows; with one row the
next document is itself. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQ_HASHES, SHIFTS = 4, 30
EQ_LANES = 64 * EQ_HASHES // 15
_FIELDS = 1 | 1 << 30
_M60, _M30 = (1 << 60) - 1, (1 << 30) - 1
#: Runs of up to four words within a line.
RUN = r"(?:[^ \n\t\r]+[ \t\r]*){1,4}"
#: Rows of a range of ids that one window holds, about, and ranges at most.
RANGE_ROWS, RANGES = 4000, 1 << 16


def vector(text: str) -> str:
    """SQL of a text's fingerprint: struct<eq array<bigint>, sim array<bigint>, n bigint>."""
    wide = ", ".join(f"sha2(concat('{k}:', p), 256)" for k in range(EQ_HASHES))
    hashes = f"array(transform(split({text}, '\\n', -1), p -> concat({wide})))"
    eq = f"transform({hashes}, hs -> transform(sequence(0, {EQ_LANES - 1}), j -> aggregate(hs, 0L, (s, h) -> (s + cast(conv(substr(h, 1 + 15 * j, 15), 16, 10) as bigint)) & {_M60}L)))[0]"
    run = RUN.replace("\\", "\\\\")
    runs = f"array(transform(regexp_extract_all({text}, '{run}', 0), r -> md5(rtrim(' \\t\\r', r))))"
    # the two halves of each hash, once; then one sum for each shift and half
    halves = "array(struct(transform(hs, h -> cast(conv(substr(h, 1, 15), 16, 10) as bigint)) as a, transform(hs, h -> cast(conv(substr(h, 16, 15), 16, 10) as bigint)) as b))"
    sums = lambda c: f"transform(sequence(0, {SHIFTS - 1}), j -> aggregate(z.{c}, 0L, (s, h) -> (s + (shiftright(h, j) & {_FIELDS}L)) & {_M60}L))"
    sim = f"transform({runs}, hs -> transform({halves}, z -> struct(concat({sums('a')}, {sums('b')}) as sim, cast(size(hs) as bigint) as n))[0])[0]"
    return f"transform(array({sim}), x -> struct({eq} as eq, x.sim as sim, x.n as n))[0]"


def add(a: str, b: str) -> str:
    """SQL of the fingerprint of both texts' paragraphs together."""
    return f"struct(zip_with({a}.eq, {b}.eq, (x, y) -> (x + y) & {_M60}L) as eq, zip_with({a}.sim, {b}.sim, (x, y) -> (x + y) & {_M60}L) as sim, {a}.n + {b}.n as n)"


def subtract(a: str, b: str) -> str:
    """SQL of the fingerprint of a's paragraphs without b's."""
    return f"struct(zip_with({a}.eq, {b}.eq, (x, y) -> (x - y) & {_M60}L) as eq, zip_with({a}.sim, {b}.sim, (x, y) -> (x - y) & {_M60}L) as sim, {a}.n - {b}.n as n)"


def text_of(v: str) -> str:
    """SQL of a fingerprint as a string."""
    return f"concat(array_join(transform({v}.eq, x -> lpad(lower(hex(x)), 15, '0')), ''), ':', array_join(transform({v}.sim, x -> lpad(lower(hex(x)), 15, '0')), ''), ':', cast({v}.n as string))"


def _projection(v: str) -> str:
    """The counters' distances from half of the runs, times two."""
    return f"flatten(transform({v}.sim, x -> array(2 * (x & {_M30}L) - {v}.n, 2 * shiftright(x, 30) - {v}.n)))"


def likeness(a: str, b: str) -> str:
    """SQL of 2ab / (aa + bb) of the projections, within 0 and 1."""
    dot = lambda x, y: f"aggregate(zip_with(z.{x}, z.{y}, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)"
    part = f"transform(array(struct({_projection(a)} as p, {_projection(b)} as q)), z -> struct({dot('p', 'q')} as pq, {dot('p', 'p')} + {dot('q', 'q')} as sum))[0]"
    return f"transform(array({part}), z -> case when z.sum = 0 then if({a}.eq = {b}.eq, 1D, 0D) else greatest(0D, least(1D, 2 * z.pq / z.sum)) end)[0]"


def _ranges(keys: DataFrame) -> tuple[list[int], int | None]:
    """Upper ends of ranges of k, some thousand rows each, and the highest k; a few numbers, from ids alone."""
    n, top = keys.agg(F.count("*"), F.max("k")).first()
    parts = min(RANGES, -(-n // RANGE_ROWS))
    if parts < 2:
        return [], top
    at = _constant([i / parts for i in range(1, parts)], "double")
    cuts = keys.agg(F.expr(f"percentile_approx(k, {at}, {max(10_000, 4 * parts)})").alias("cuts")).first()["cuts"]
    return sorted(set(cuts) - {top}), top


def _constant(values: list, kind: str) -> str:
    """SQL of a constant array, one literal however long."""
    return f"from_json('{json.dumps(values)}', 'array<{kind}>')"


def _range_of(k: str, cuts: list[int]) -> tuple[Column, Column]:
    """How many cuts are below k, first among those that end blocks of them, then in the block; and whether k is the next."""
    if not cuts:
        return F.lit(0), F.lit(False)
    side = math.isqrt(len(cuts) - 1) + 1
    ends, every = _constant(cuts[side - 1 :: side], "bigint"), _constant(cuts, "bigint")
    block = f"size(filter({ends}, x -> x < {k})) * {side}"
    own = f"({block} + size(filter(slice({every}, {block} + 1, {side}), x -> x < {k})))"
    return F.expr(own), F.coalesce(F.expr(f"get({every}, {own}) = {k}"), F.lit(False))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, v (its fingerprint) and next_text, next_v of the next row in descending doc_id, the first row's after the last.

    Ranges of ids are windows of their own. The row at a range's top is put
    behind the range above as well (the topmost behind the lowest), so no row
    needs another range and no task sees all rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    cuts, top = _ranges(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("k")))
    if top is None:
        top = 0
    own, is_cut = _range_of("k", cuts)
    spot = lambda r, behind: F.struct(r.cast("int").alias("r"), F.lit(behind).alias("behind"))
    none = F.array().cast("array<struct<r:int,behind:int>>")
    spots = F.concat(F.array(spot(own, 0)), F.when(is_cut, F.array(spot(own + 1, 1))).otherwise(none), F.when(F.col("k") == F.lit(top), F.array(spot(F.lit(0), 1))).otherwise(none))
    dealt = keyed.withColumn("v", F.expr(vector("text"))).withColumn("tie", F.xxhash64("text")).select("*", F.explode(spots).alias("spot")).select("*", "spot.r", "spot.behind").drop("spot")
    order = Window.partitionBy("r").orderBy("behind", F.desc("k"), "tie", "text")
    both = dealt.withColumn("following", F.lead(F.struct("text", "v")).over(order))
    return both.where("behind = 0").select("doc_id", "text", "v", F.col("following.text").alias("next_text"), F.col("following.v").alias("next_v"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of each text, as a string."""
    return docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.expr(vector("text")).alias("v")).select("doc_id", F.expr(text_of("v")).alias("fingerprint"))


def op5_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    from .runtime import table

    rows = with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    third = "cast(floor(n_chars / 3) as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {third}), substring(next_text, 1, {third}))"))
    told = f"transform(array({vector('edited')}), e -> struct({text_of('e')} as f, {likeness('v', 'e')} as near))[0]"
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.expr(text_of("v")).alias("fingerprint"), F.expr(told).alias("e"), F.expr(likeness("v", "next_v")).alias("near_next"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("e.f").alias("edited_fingerprint"), F.col("e.near").alias("near_edited"), "near_next")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    run = RUN
    wide = " || ".join(f"sha256('{k}:' || p)" for k in range(EQ_HASHES))
    vec = lambda t: f"""struct_pack(
        eq := list_transform(range(0, {EQ_LANES}), lambda j: (list_sum(list_transform(string_split({t}, chr(10)), lambda p: ('0x' || substr({wide}, 1 + 15 * j::int, 15))::bigint)) & {_M60})::bigint),
        hs := list_transform(regexp_extract_all({t}, '{run}', 0), lambda r: md5(rtrim(r, chr(32) || chr(9) || chr(13)))))"""  # noqa: E731
    half = lambda c, at: f"list_transform(range(0, {SHIFTS}), lambda j: (coalesce(list_sum(list_transform({c}.hs, lambda h: (('0x' || substr(h, {at}, 15))::bigint >> j) & {_FIELDS})), 0) & {_M60})::bigint)"
    full = lambda c: f"struct_pack(eq := {c}.eq, sim := list_concat({half(c, 1)}, {half(c, 16)}), n := len({c}.hs)::bigint)"
    string = lambda c: f"array_to_string(list_transform({c}.eq, lambda x: lpad(lower(to_hex(x)), 15, '0')), '') || ':' || array_to_string(list_transform({c}.sim, lambda x: lpad(lower(to_hex(x)), 15, '0')), '') || ':' || {c}.n::varchar"
    proj = lambda c: f"flatten(list_transform({c}.sim, lambda x: [2 * (x & {_M30}) - {c}.n, 2 * (x >> 30) - {c}.n]))"
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1]::double * z[2]))"
    like = lambda a, b: f"case when {dot(a + 'p', a + 'p')} + {dot(b + 'p', b + 'p')} = 0 then case when {a}.eq = {b}.eq then 1.0 else 0.0 end else greatest(0.0, least(1.0, 2 * {dot(a + 'p', b + 'p')} / ({dot(a + 'p', a + 'p')} + {dot(b + 'p', b + 'p')}))) end::double"
    return f"""
with d as (select doc_id::bigint doc_id, coalesce(text, '') as t from documents),
o as (select doc_id, t, row_number() over (order by doc_id desc nulls last, t) r, count(*) over () n from d),
e as (select a.doc_id, a.t, b.t nt, substr(a.t, 1, length(a.t) - (length(a.t) // 3)) || substr(b.t, 1, length(a.t) // 3) ed
      from o a join o b on b.r = a.r % a.n + 1),
h as (select *, {vec('t')} hv, {vec('nt')} hn, {vec('ed')} he from e),
f as (select *, {full('hv')} v, {full('hn')} nv, {full('he')} ev from h),
p as (select *, {proj('v')} vp, {proj('nv')} nvp, {proj('ev')} evp from f)
select doc_id, length(t)::bigint n_chars, sha256(ed) edited_sha256, {string('v')} fingerprint, {string('ev')} edited_fingerprint,
       {like('v', 'ev')} near_edited, {like('v', 'nv')} near_next
from p"""
