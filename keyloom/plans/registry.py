"""Named queries of the discovery engine and the SQL that they are held against.

The lake: `lineitem` in 20 tables (by order key), with the columns order, part and supplier key,
return flag and line status. The queries are whole tables too: all keys of `lineitem`, and `supplier`.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.hashing import ALPHABET, SEGMENTS, family, lanes_of, md5_lanes, charfeat_positions
from keyloom.functions.text import MISSING, clean_text, clean_text_sql, lower_all, shingles, split_list
from keyloom.operators import coding, discover, index, metrics, passes, query
from keyloom.sources import corpus

LAKE = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]
K = 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lake(spark: SparkSession, sf_dir: str, by_rows: bool = False) -> DataFrame:
    """by_rows: for the index by rows, which makes repeated postings one itself."""
    rows = read(spark, sf_dir, "lineitem")
    make = corpus.shred_rows if by_rows else corpus.shred
    return make(rows, 100 + F.col("l_orderkey") % 20, F.col("l_orderkey") * 10 + F.col("l_linenumber"), LAKE, clean=False)


def keys_query(spark: SparkSession, sf_dir: str, n: int) -> query.QuerySpec:
    if n == 1:
        return query.QuerySpec.from_df(read(spark, sf_dir, "supplier"), ["s_suppkey"], clean=False)
    return query.QuerySpec.from_df(read(spark, sf_dir, "lineitem"), KEYS[:n], clean=False)


LAKE_SQL = " UNION ".join(
    f"SELECT 100 + l_orderkey % 20 AS table_id, l_orderkey * 10 + l_linenumber AS row_id, {i} AS col_id, lower(CAST({c} AS VARCHAR)) AS token FROM lineitem" for i, c in enumerate(LAKE)
)


def _query_sql(n: int) -> str:
    if n == 1:
        return "SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS k0 FROM supplier"
    return "SELECT DISTINCT " + ", ".join(f"CAST({c} AS VARCHAR) AS k{i}" for i, c in enumerate(KEYS[:n])) + " FROM lineitem"


def _pairs_sql(n: int, mode: str = "concat", least: str = "") -> str:
    ks = ", ".join(f"k{i}" for i in range(n))
    ident = f"{ks}, table_id, row_id, c0"
    head = f"WITH p AS MATERIALIZED ({LAKE_SQL}), q AS MATERIALIZED ({_query_sql(n)}), cand AS MATERIALIZED (SELECT {ks}, p.table_id, p.row_id, p.col_id AS c0 FROM p JOIN q ON p.token = q.k0 {least})"
    if n == 1:
        return head + f", pairs AS (SELECT {ident}, CAST(c0 AS VARCHAR) AS mapping FROM cand)"
    if mode == "injective":
        joins = " ".join(f"JOIN p AS p{i} ON p{i}.table_id = cand.table_id AND p{i}.row_id = cand.row_id AND p{i}.token = k{i} AND p{i}.col_id NOT IN (c0{''.join(f', p{j}.col_id' for j in range(1, i))})" for i in range(1, n))
        named = " || '_' || ".join(["c0", *[f"p{i}.col_id" for i in range(1, n)]])
        return head + f", pairs AS (SELECT {ks}, cand.table_id, cand.row_id, {named} AS mapping FROM cand {joins})"
    cells = " UNION ALL ".join(f"SELECT {ks}, cand.table_id, cand.row_id, c0, {i} AS pos, p.col_id FROM cand JOIN p ON p.table_id = cand.table_id AND p.row_id = cand.row_id AND p.token = k{i}" for i in range(1, n))
    return head + f", cells AS ({cells}), pairs AS (SELECT {ident}, c0 || '_' || string_agg(CAST(col_id AS VARCHAR), '_' ORDER BY pos, col_id) AS mapping FROM cells GROUP BY {ident} HAVING count(DISTINCT pos) = {n - 1})"


def discover_sql(n: int, mode: str = "concat", least: str = "") -> str:
    distinct = "count(DISTINCT (" + ", ".join(f"k{i}" for i in range(n)) + "))" if n > 1 else "count(DISTINCT k0)"
    return (
        _pairs_sql(n, mode, least)
        + f""", s AS (SELECT table_id, mapping, count(*) AS n_pairs, {distinct} AS j_distinct FROM pairs GROUP BY table_id, mapping),
b AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY n_pairs DESC, mapping) AS r FROM s)
SELECT row_number() OVER (ORDER BY n_pairs DESC, table_id) AS rank, table_id, mapping, n_pairs, j_distinct FROM b WHERE r = 1 ORDER BY n_pairs DESC, table_id LIMIT {K}"""
    )


def q_discover(spark: SparkSession, sf_dir: str, n: int, fam: str | None = None, **options) -> DataFrame:
    """From raw rows to the result in parts and passes; a part of the index goes with its scores, those at exit."""
    return passes.discover_in_parts(lake(spark, sf_dir, by_rows=True), family(fam) if fam else None, keys_query(spark, sf_dir, n), K, width=len(LAKE), **options)


def stored_index(spark: SparkSession, sf_dir: str, fam: str) -> str:
    """An index of the lake by postings, written to a folder that all executors share (a temporary one in a local session)."""
    path = f"{passes.shared_folder(spark)}/index"
    index.write_index(index.build_index(lake(spark, sf_dir), family(fam)), family(fam), path)
    return path


def q_stored(spark: SparkSession, sf_dir: str, fam: str, **options) -> DataFrame:
    """The index is written with its family, and read again before the query."""
    path = passes.shared_folder(spark)
    passes.write_rows(lake(spark, sf_dir, by_rows=True), family(fam), path)
    return passes.discover(passes.read_rows(spark, path, family(fam)), keys_query(spark, sf_dir, 2), K, **options)


QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


for _n in (1, 2, 3):
    register(f"discover_scr_{_n}key", partial(q_discover, n=_n), discover_sql(_n))
for _fam in ("charfeat", "md5", "bloom", "simhash", "xx", "murmur", "bloom_murmur"):
    register(f"discover_{_fam}", partial(q_discover, n=2, fam=_fam), discover_sql(2))
register("discover_stored", partial(q_stored, fam="charfeat"), discover_sql(2))
register("discover_ics", partial(q_stored, fam="charfeat", run_ics=True, mode="injective"), discover_sql(2, "injective"))
LEAST = "WHERE p.table_id IN (SELECT table_id FROM p WHERE token IN (SELECT k0 FROM q) GROUP BY table_id HAVING count(*) >= {})"
register("discover_min_join", partial(q_discover, n=2, fam="charfeat", min_join=3000, absolute=True), discover_sql(2, least=LEAST.format(3000)))
register("discover_charfeat_3key", partial(q_discover, n=3, fam="charfeat"), discover_sql(3))
register("discover_injective", partial(q_discover, n=3, fam="charfeat", mode="injective"), discover_sql(3, "injective"))
register("discover_pruned", partial(q_discover, n=2, fam="charfeat", prune=12), discover_sql(2))

HITS_SQL = f"WITH p AS MATERIALIZED ({LAKE_SQL}), q AS (SELECT DISTINCT k0 FROM ({_query_sql(2)}))"
COUNT_SQL = HITS_SQL + ", h AS (SELECT table_id, count(*) AS n_hits FROM p WHERE token IN (SELECT k0 FROM q) GROUP BY table_id)"

register("shred_postings", lambda s, d: corpus.shred(read(s, d, "orders"), 1 + F.col("o_custkey") % 5, F.col("o_orderkey"), ["o_custkey", "o_orderstatus", "o_orderpriority"], unique=True),
         "SELECT * FROM (" + " UNION ALL ".join(f"SELECT 1 + o_custkey % 5 AS table_id, o_orderkey AS row_id, CAST({i} AS INTEGER) AS col_id, {clean_text_sql(c)} AS token FROM orders" for i, c in enumerate(["o_custkey", "o_orderstatus", "o_orderpriority"])) + ") WHERE token <> ''")
register("clean_text_documents", lambda s, d: read(s, d, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned")), f"SELECT doc_id, {clean_text_sql('text')} AS cleaned FROM documents")
register("query_prepare", lambda s, d: query.QuerySpec.from_df(read(s, d, "part"), ["p_name", "p_type"]).rows,
         f"WITH r AS (SELECT DISTINCT p_name, p_type FROM part), c AS (SELECT {clean_text_sql('p_name')} AS k0, {clean_text_sql('p_type')} AS k1 FROM r) SELECT k0, k1, count(*) AS m FROM c WHERE k0 NOT IN {MISSING} AND k1 NOT IN {MISSING} GROUP BY k0, k1")
register("posting_lists", lambda s, d: discover.posting_lists(lake(s, d), keys_query(s, d, 2).rows, "k0"), HITS_SQL + " SELECT DISTINCT * FROM p WHERE token IN (SELECT k0 FROM q)")
register("posting_lists_topk", lambda s, d: discover.posting_lists(lake(s, d), keys_query(s, d, 2).rows, "k0", 100),
         HITS_SQL + r" SELECT DISTINCT * FROM p WHERE regexp_replace(regexp_replace(token, '\W+', ' ', 'g'), ' +', ' ', 'g') IN (SELECT k0 FROM q) ORDER BY table_id, row_id, col_id, token LIMIT 100")
register("table_hit_counts", lambda s, d: discover.table_hits(lake(s, d), keys_query(s, d, 2)), COUNT_SQL + " SELECT * FROM h")
register("min_join_abs", lambda s, d: discover.min_join_filter(discover.table_hits(lake(s, d), keys_query(s, d, 2)), 3000, True, 0), COUNT_SQL + " SELECT * FROM h WHERE n_hits >= 3000")
register("min_join_rel", lambda s, d: discover.min_join_filter(discover.table_hits(lake(s, d), keys_query(s, d, 2)), 0.1, False, keys_query(s, d, 2).size()),
         COUNT_SQL + f" SELECT * FROM h WHERE n_hits >= round_even(0.1 * (SELECT count(*) FROM ({_query_sql(2)})), 0)")
FETCHED = {"n_cells": "count(*)", "n_rows": "count(DISTINCT row_id)", "row_sum": "sum(row_id)", "col_sum": "sum(col_id)", "n_chars": "sum(length(token))"}
register("row_fetch", lambda s, d: discover.fetch_rows(lake(s, d), discover.candidates(lake(s, d), keys_query(s, d, 1))).groupBy("table_id").agg(*[F.expr(f"cast({x} as long)").alias(n) for n, x in FETCHED.items()]),
         f"WITH p AS MATERIALIZED ({LAKE_SQL}), c AS (SELECT DISTINCT table_id, row_id FROM p WHERE token IN (SELECT k0 FROM ({_query_sql(1)}))) SELECT table_id, " + ", ".join(f"CAST({x} AS BIGINT) AS {n}" for n, x in FETCHED.items()) + " FROM p SEMI JOIN c USING (table_id, row_id) GROUP BY table_id")
register("ics_order", lambda s, d: query.key_counts(keys_query(s, d, 3)), f"WITH q AS ({_query_sql(3)}) " + " UNION ALL ".join(f"SELECT {i} AS position, count(DISTINCT k{i}) AS n_distinct FROM q" for i in range(3)))


def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.explode(F.array(*[F.lower(F.col(c).cast("string")) for c in ("p_name", "p_brand", "p_type", "p_size")])).alias("token")).distinct()


PART_SQL = "SELECT DISTINCT token FROM (" + " UNION ALL ".join(f"SELECT lower(CAST({c} AS VARCHAR)) AS token FROM part" for c in ("p_name", "p_brand", "p_type", "p_size")) + ")"


def charfeat_sql(tokens: str, bits: int, ones: int = 5, chars: bool = True, location: bool = True, length: bool = True, rotation: bool = True) -> str:
    """CTEs up to b(token, bit)."""
    seg, area = SEGMENTS[bits], len(ALPHABET) * SEGMENTS[bits]
    rest = bits - area
    part = f"CASE WHEN s = 0 THEN 0 ELSE (s * {seg} - 1) // (n * cnt) END" if location else "0"
    turn = f"({area} * (n % {rest})) // {rest}" if rotation else "0"
    sets = []
    if chars:
        sets.append(f"SELECT token, ((instr('{ALPHABET}', c) - 1) * {seg} + {part} + {turn}) % {area} AS bit FROM f WHERE r <= {ones} AND instr('{ALPHABET}', c) > 0")
    if length:
        sets.append(f"SELECT token, {area} + length(token) % {rest} AS bit FROM tok")
    return f"""tok AS MATERIALIZED ({tokens}),
ch AS (SELECT token, length(token) AS n, i AS idx, substr(token, CAST(i + 1 AS INTEGER), 1) AS c FROM (SELECT token, unnest(range(0, length(token))) AS i FROM tok)),
f AS (SELECT token, n, c, count(*) AS cnt, CAST(sum(idx) AS BIGINT) AS s, row_number() OVER (PARTITION BY token ORDER BY count(*), c) AS r FROM ch GROUP BY token, n, c),
b AS ({' UNION '.join(sets)})"""


def q_charfeat(spark: SparkSession, sf_dir: str, bits: int, **flags: bool) -> DataFrame:
    return part_tokens(spark, sf_dir).select("token", F.array_join(charfeat_positions(F.col("token"), bits, **flags), ",").alias("bits"))


JOINED_BITS = "string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit)"
for _bits in (64, 128, 256, 512):
    register(f"charfeat_bits_{_bits}", partial(q_charfeat, bits=_bits), f"WITH {charfeat_sql(PART_SQL, _bits)} SELECT token, {JOINED_BITS} AS bits FROM b GROUP BY token")
for _name, _flags in {
    "length": {"chars": False},
    "chars": {"location": False, "length": False, "rotation": False},
    "loc": {"length": False, "rotation": False},
    "norot": {"rotation": False},
}.items():
    register(f"charfeat_ablation_{_name}", partial(q_charfeat, bits=128, **_flags), f"WITH {charfeat_sql(PART_SQL, 128, **_flags)} SELECT token, {JOINED_BITS} AS bits FROM b GROUP BY token")


def q_superkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    fam = family("charfeat")
    keys = index.row_keys(lake(spark, sf_dir), fam)

    def set_bits(k: int) -> F.Column:
        lane = F.col(fam.columns[k])
        bit = lambda p: F.when(F.call_function("shiftright", lane, p).bitwiseAND(F.lit(1).cast("long")) == 1, p + 64 * k)
        return F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), lambda x: x.isNotNull())

    each = F.concat(*[set_bits(k) for k in range(len(fam.columns))])
    return keys.select("table_id", "row_id", F.array_join(each, ",").alias("bits"))


register("superkey_128", q_superkey, f"WITH p AS MATERIALIZED ({LAKE_SQL}), {charfeat_sql('SELECT DISTINCT token FROM p', 128)} SELECT table_id, row_id, {JOINED_BITS} AS bits FROM (SELECT DISTINCT table_id, row_id, bit FROM p JOIN b USING (token)) GROUP BY table_id, row_id")


def q_mcr(spark: SparkSession, sf_dir: str, most: int = 500) -> DataFrame:
    return discover.discover_mcr(lake(spark, sf_dir), keys_query(spark, sf_dir, 2), K, most)


MCR_SQL = f"""WITH p AS MATERIALIZED ({LAKE_SQL}), q AS MATERIALIZED ({_query_sql(2)}), t AS (SELECT table_id FROM p WHERE token IN (SELECT k0 FROM q) GROUP BY table_id ORDER BY count(*) DESC, table_id LIMIT 500),
m AS (SELECT p.table_id, p.col_id AS c0, o.col_id AS c1, count(*) AS n_pairs FROM p JOIN p AS o ON p.table_id = o.table_id AND p.row_id = o.row_id AND p.col_id <> o.col_id JOIN q ON p.token = k0 AND o.token = k1 WHERE p.table_id IN (SELECT table_id FROM t) GROUP BY ALL),
top AS (SELECT * FROM m ORDER BY n_pairs DESC, table_id, c0, c1 LIMIT {K})"""
register("discover_mcr", q_mcr, MCR_SQL + " SELECT * FROM top")
register("discover_mcr_cut", partial(q_mcr, most=4), MCR_SQL.replace("LIMIT 500", "LIMIT 4") + " SELECT * FROM top")
register("mcr_avg_joinability", lambda s, d: metrics.mean_joinability(lake(s, d), keys_query(s, d, 2), K), MCR_SQL + " SELECT coalesce(avg(n_pairs), 0.0) AS mean_pairs FROM top")


def q_precision(spark: SparkSession, sf_dir: str, fam: str) -> DataFrame:
    return passes.precision_in_parts(lake(spark, sf_dir, by_rows=True), family(fam), keys_query(spark, sf_dir, 2), width=len(LAKE))


def precision_sql(fam: str) -> str:
    """Approved pairs from whole keys: no bit of the query's keys is missing in the row."""
    tokens = "SELECT DISTINCT token FROM p UNION SELECT k0 FROM q UNION SELECT k1 FROM q"
    if fam == "charfeat":
        hashed = f"{charfeat_sql(tokens, 128)}, x AS MATERIALIZED (SELECT token, bit_or(CAST(1 AS UHUGEINT) << CAST(bit AS UHUGEINT)) AS h FROM b GROUP BY token)"
    else:
        half = "CAST(CAST('0x' || substr(md5(token), {}, 16) AS UBIGINT) AS UHUGEINT)"
        hashed = f"x AS MATERIALIZED (SELECT token, ({half.format(1)} << CAST(64 AS UHUGEINT)) | {half.format(17)} AS h FROM ({tokens}))"
    return (
        _pairs_sql(2)
        + f""", {hashed},
rk AS (SELECT table_id, row_id, bit_or(h) AS h FROM p JOIN x USING (token) GROUP BY table_id, row_id),
ok AS (SELECT count(*) AS approved FROM cand JOIN rk USING (table_id, row_id) JOIN x AS a ON a.token = k0 JOIN x AS c ON c.token = k1 WHERE ((a.h | c.h) & rk.h) = (a.h | c.h)),
mt AS (SELECT count(*) AS matched FROM pairs)
SELECT approved, matched, approved - matched AS false_positives, matched / approved AS precision FROM ok, mt"""
    )


register("filter_precision", partial(q_precision, fam="charfeat"), precision_sql("charfeat"))
register("filter_precision_md5", partial(q_precision, fam="md5"), precision_sql("md5"))
register("approved_rows", lambda s, d: metrics.approved_rows(lake(s, d), keys_query(s, d, 2), None), HITS_SQL + " SELECT table_id, count(DISTINCT row_id) AS n_rows FROM p WHERE token IN (SELECT k0 FROM q) GROUP BY table_id")
register("md5_lanes", lambda s, d: part_tokens(s, d).select("token", *[x.cast("string").alias(f"sk{k}") for k, x in enumerate(md5_lanes(F.col("token")))]),
         f"""WITH t AS ({PART_SQL}), h AS (SELECT token, CAST('0x' || substr(md5(token), 17, 16) AS UBIGINT) AS lo, CAST('0x' || substr(md5(token), 1, 16) AS UBIGINT) AS hi FROM t)
SELECT token, CAST(CASE WHEN lo > 9223372036854775807 THEN CAST(lo AS HUGEINT) - 18446744073709551616 ELSE CAST(lo AS HUGEINT) END AS VARCHAR) AS sk0,
CAST(CASE WHEN hi > 9223372036854775807 THEN CAST(hi AS HUGEINT) - 18446744073709551616 ELSE CAST(hi AS HUGEINT) END AS VARCHAR) AS sk1 FROM h""")  # fmt: skip
register("simhash_shingles", lambda s, d: part_tokens(s, d).select("token", F.array_join(shingles(F.col("token")), "|").alias("pieces")),
         rf"""WITH t AS ({PART_SQL}), c AS (SELECT token, regexp_replace(lower(token), '[^\w]+', '', 'g') AS x FROM t)
SELECT token, array_to_string(list_transform(range(0, greatest(length(x) - 3, 0) + 1), lambda i: substr(x, CAST(i + 1 AS INTEGER), 3)), '|') AS pieces FROM c""")  # fmt: skip
register("simhash_lanes", lambda s, d: family("simhash").attach(part_tokens(s, d), "token").select("token", F.col("sk0").cast("string").alias("sk0"), F.col("sk1").cast("string").alias("sk1")),
         rf"""WITH t AS ({PART_SQL}), c AS (SELECT token, regexp_replace(lower(token), '[^\w]+', '', 'g') AS x FROM t),
f AS (SELECT token, substr(x, CAST(unnest(range(0, greatest(length(x) - 3, 0) + 1)) + 1 AS INTEGER), 3) AS piece FROM c),
h AS (SELECT token, lane, CAST('0x' || substr(md5(piece), 17 - 16 * lane, 16) AS UBIGINT) AS v FROM f, (VALUES (0), (1)) AS l(lane)),
b AS (SELECT token, lane, j FROM h, range(64) AS r(j) GROUP BY token, lane, j HAVING sum(CASE WHEN (v >> CAST(j AS UBIGINT)) & 1 = 1 THEN 1 ELSE -1 END) > 0),
s AS (SELECT token, lane, sum(CASE WHEN j = 63 THEN -9223372036854775808 ELSE CAST(1 AS HUGEINT) << CAST(j AS HUGEINT) END) AS v FROM b GROUP BY token, lane)
SELECT token, CAST(coalesce(a.v, 0) AS VARCHAR) AS sk0, CAST(coalesce(z.v, 0) AS VARCHAR) AS sk1 FROM t LEFT JOIN (SELECT token, v FROM s WHERE lane = 0) AS a USING (token) LEFT JOIN (SELECT token, v FROM s WHERE lane = 1) AS z USING (token)""")  # fmt: skip
register("lower_cast_all", lambda s, d: lower_all(read(s, d, "nation")), "SELECT lower(CAST(n_nationkey AS VARCHAR)) AS n_nationkey, lower(n_name) AS n_name, lower(CAST(n_regionkey AS VARCHAR)) AS n_regionkey FROM nation")
register("split_list", lambda s, d: read(s, d, "documents").select("doc_id", F.posexplode(split_list(F.col("text"), ", ")).alias("pos", "part")),
         "SELECT doc_id, CAST(unnest(range(0, len(x))) AS INTEGER) AS pos, unnest(x) AS part FROM (SELECT doc_id, string_split(text, ', ') AS x FROM documents)")
register("huffman_codes", lambda s, d: coding.huffman_codes(read(s, d, "part"), "p_type"))


def q_bloom_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token is found in its row's filter: no false negatives."""
    fam = family("bloom")
    at = index.build_index(lake(spark, sf_dir), fam)
    hit = discover.contains([F.col(c) for c in fam.columns], [F.col(f"own_{c}") for c in fam.columns])
    return fam.attach(at, "token", "own_").groupBy("table_id").agg(F.count("*").alias("n_tokens"), F.sum(hit.cast("long")).alias("n_found"))


register("bloom_check", q_bloom_check, f"WITH p AS ({LAKE_SQL}) SELECT table_id, count(*) AS n_tokens, count(*) AS n_found FROM p GROUP BY table_id")
