"""The comparison queries over the driver's tables, each with SQL that says the same.

A pair is a table and a changed copy of it. Its select lists are plain expressions that Spark and other engines read alike, so that the
query and its SQL start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdelta.functions.keys import fingerprint, fingerprint_hash, row_key
from rowdelta.functions.normalize import normalized
from rowdelta.functions.similarity import jaro_winkler, normalized_levenshtein
from rowdelta.functions.textdiff import word_diff
from rowdelta.operators import content, keyed
from rowdelta.options import DiffOptions, StreamingConfig
from rowdelta.plans.diff import DiffResult, diff
from rowdelta.plans.scratch import scratch, settled
from rowdelta.plans.search import parse_search, remove_token
from rowdelta.sources.codec import decode_frame, encode_rows, frame_head, read_frames, to_json, write_frames
from rowdelta.sources.csv_files import read_csv, write_csv
from rowdelta.sources.csv_text import read_csv_text, sample
from rowdelta.sources.dataset import INDEX, Dataset, from_table, numbered
from rowdelta.streaming.incremental import Differ, StreamingKeyDiff, stream_csv

Query = Callable[[SparkSession, str], DataFrame]
#: Row indexes of a result, -1 where a side has no row.
_INDEXES = ("coalesce(source_idx, -1) as source_idx", "coalesce(target_idx, -1) as target_idx")
STRICT = {"case_sensitive": True, "ignore_whitespace": False, "ignore_empty_vs_null": False}


@dataclass(frozen=True)
class Pair:
    """``source`` and ``target`` map column names to expressions over ``table``; ``doubles`` are shown with two decimals."""

    table: str
    index: str
    source: dict[str, str]
    target: dict[str, str]
    where: str = "true"
    target_index: str | None = None
    doubles: tuple[str, ...] = ()
    source_where: str = "true"

    def read(self, spark: SparkSession, sf_dir: str) -> tuple[Dataset, Dataset]:
        t = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        cell = lambda n, e: f"CAST({e} AS DECIMAL(18,2)) AS {n}" if n in self.doubles else f"{e} AS {n}"
        side = lambda cols, index, where: from_table(t.where(where).selectExpr(f"{index} as _i", *[cell(n, e) for n, e in cols.items()]), "_i", list(cols))
        return side(self.source, self.index, self.source_where), side(self.target, self.target_index or self.index, self.where)

    def _text(self, name: str, expr: str) -> str:
        return f"coalesce(CAST({f'CAST({expr} AS DECIMAL(18,2))' if name in self.doubles else expr} AS VARCHAR), '')"

    def sql(self) -> str:
        """Common table expressions ``s`` and ``t`` of text cells with an ``i``."""
        one = lambda cols, index, where: f"SELECT {index} AS i, {', '.join(f'{self._text(n, e)} AS {n}' for n, e in cols.items())} FROM {self.table} WHERE {where}"
        return f"s AS ({one(self.source, self.index, self.source_where)}),\nt AS ({one(self.target, self.target_index or self.index, self.where)})"


def _plain(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_O = _plain("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_O_NEW = _O | {
    "o_orderkey": "CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END",
    "o_orderstatus": "CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END",
    "o_totalprice": "CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END",
}
ORDERS = Pair("orders", "o_orderkey", _O, _O_NEW, "o_orderkey % 17 <> 0", doubles=("o_totalprice",))
_C = _plain("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
CUSTOMER = Pair(
    "customer", "c_custkey", _C | {"c_mktsegment": "CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_mktsegment END"},
    _C | {
        "c_name": "CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) WHEN c_custkey % 7 = 0 THEN concat('  ', c_name, ' ') ELSE c_name END",
        "c_mktsegment": "CASE WHEN c_custkey % 9 = 0 THEN 'NULL' WHEN c_custkey % 11 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END",
        "c_acctbal": "CASE WHEN c_custkey % 23 = 0 THEN c_acctbal + 5 ELSE c_acctbal END",
    }, doubles=("c_acctbal",),
)
ORDERS_FEWER = Pair("orders", "o_orderkey", _plain("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), _plain("o_orderkey", "o_orderdate") | {"o_orderstatus": _O_NEW["o_orderstatus"]}, "o_orderkey % 17 <> 0")
EVENTS = Pair(
    "events", "event_id", _plain("event_id", "user_id", "event_type", "value", "props"),
    _plain("event_id", "user_id", "event_type", "value", "props") | {"event_type": "CASE WHEN event_id % 10 = 3 THEN 'changed' ELSE event_type END", "user_id": "CASE WHEN event_id % 31 = 0 THEN user_id + 1 ELSE user_id END"},
    "event_id % 29 <> 0", doubles=("value",),
)
_L_INDEX = "l_orderkey * 8 + l_linenumber"
LINES = Pair("lineitem", _L_INDEX, _plain("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"), _plain("l_returnflag", "l_linestatus", "l_linenumber") | {"l_quantity": "CASE WHEN l_orderkey % 5 = 0 THEN l_quantity + 1 ELSE l_quantity END"}, "l_orderkey % 7 <> 0", doubles=("l_quantity",))
_P = _plain("p_name", "p_brand", "p_type", "p_size")
PARTS = Pair("part", "p_partkey", _P, _P | {"p_size": "CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END"}, "p_partkey % 10 <> 0")
_S = _plain("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
SUPPLIERS = Pair(
    "supplier", "s_suppkey", _S,
    _S | {"s_suppkey": "CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 7 ELSE s_suppkey END", "s_name": "CASE WHEN s_suppkey % 6 = 0 THEN concat(s_name, ' Ltd') ELSE s_name END", "s_nationkey": "CASE WHEN s_suppkey % 10 = 0 THEN s_nationkey + 1 ELSE s_nationkey END"},
    "s_suppkey % 9 <> 0", doubles=("s_acctbal",),
)
NATIONS = Pair("nation", "n_nationkey", _plain("n_nationkey", "n_name", "n_regionkey"), {"id": "n_nationkey", "title": "CASE WHEN n_nationkey % 3 = 0 THEN concat(n_name, 'X') ELSE n_name END", "region": "n_regionkey"}, "n_nationkey % 8 <> 0")

CUSTOMERS = Pair("customer", "c_custkey", _C, _C | {"c_name": "CASE WHEN c_custkey % 5 = 0 THEN concat(c_name, 'x') ELSE c_name END", "c_custkey": "CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 3 ELSE c_custkey END", "c_acctbal": "CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END"}, "c_custkey % 16 <> 0", doubles=("c_acctbal",))
REGIONS = Pair("nation", "n_nationkey", _plain("n_nationkey", "n_name", "n_regionkey"), _plain("n_nationkey", "n_name", "n_regionkey") | {"n_name": "CASE WHEN n_nationkey % 3 = 0 THEN concat(n_name, 'X') ELSE n_name END"}, "n_nationkey % 8 <> 0")


# SQL of the pieces.


def _norm(c: str, o: DiffOptions) -> str:
    out = f"trim({c})" if o.ignore_whitespace else c
    out = out if o.case_sensitive else f"lower({out})"
    if o.ignore_empty_vs_null:
        sentinel = "EMPTY_OR_NULL" if o.case_sensitive else "empty_or_null"
        out = f"CASE WHEN trim({c}) = '' OR lower(trim({c})) = 'null' THEN '{sentinel}' ELSE {out} END"
    return out


def _cols(p: Pair, o: DiffOptions) -> list[str]:
    return [c for c in p.source if c in p.target and c not in o.excluded_columns]


def _key_sql(p: Pair, o: DiffOptions) -> str:
    """CTE ``d``: status, key, both indexes and both sides' cells of a comparison by key."""
    key = lambda a: " || '|' || ".join(f"{a}.{k}" for k in o.key_columns)
    changed = " OR ".join(f"({_norm(f's.{c}', o)}) <> ({_norm(f't.{c}', o)})" for c in _cols(p, o)) or "false"
    cells = ", ".join([f"s.{c} AS s_{c}" for c in p.source] + [f"t.{c} AS t_{c}" for c in p.target])
    return f"""WITH {p.sql()},
d AS (SELECT CASE WHEN s.i IS NULL THEN 'added' WHEN t.i IS NULL THEN 'removed' WHEN {changed} THEN 'modified' ELSE 'unchanged' END AS status,
  coalesce({key('s')}, {key('t')}) AS key, s.i AS s_i, t.i AS t_i, {cells}
  FROM s FULL JOIN t ON {key('s')} = {key('t')})"""


_COUNTS_SQL = "SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) AS total FROM "


def _flat_sql(p: Pair, o: DiffOptions) -> str:
    return "\nUNION ALL ".join(f"SELECT status, key, '{c}' AS \"column\", s_{c} AS old_value, t_{c} AS new_value FROM d WHERE status = 'modified' AND ({_norm(f's_{c}', o)}) <> ({_norm(f't_{c}', o)})" for c in _cols(p, o))


def _fp_sql(p: Pair, o: DiffOptions, a: str, target: bool = False) -> str:
    names = [c for c in p.source if c not in o.excluded_columns]
    own = dict(zip(p.source, p.target, strict=False)) if target and len(p.source) == len(p.target) else {c: c for c in p.target if c in p.source} if target else {c: c for c in p.source}
    return " || '||' || ".join(f"({_norm(f'{a}.{own[c]}', o)})" if c in own else "''" for c in names)


def _content_sql(p: Pair, o: DiffOptions) -> str:
    """CTEs of a comparison by content: exact, rs and rt (the rest), cand, scored, best and m (accepted)."""
    names = [c for c in p.source if c not in o.excluded_columns]
    own = dict(zip(p.source, p.target, strict=False)) if len(p.source) == len(p.target) else {c: c for c in names if c in p.target}
    names = [c for c in names if c in own]
    low = (lambda c: c) if o.case_sensitive else (lambda c: f"lower({c})")
    met = "\n UNION ".join(f"SELECT a.i AS si, b.i AS ti FROM rs a JOIN rt b ON a.{c} = {low(f'b.{own[c]}')} WHERE trim(a.{c}) <> ''" for c in names)
    one = lambda c: f"CASE WHEN ({_norm(f'a.{c}', o)}) = ({_norm(f'b.{own[c]}', o)}) THEN 1.0::DOUBLE ELSE jaro_winkler_similarity({_norm(f'a.{c}', o)}, {_norm(f'b.{own[c]}', o)}) END"
    return f"""WITH {p.sql()},
fs AS (SELECT i, fp, row_number() OVER (PARTITION BY fp ORDER BY i) AS rn FROM (SELECT s.i, {_fp_sql(p, o, 's')} AS fp FROM s)),
ft AS (SELECT i, fp, row_number() OVER (PARTITION BY fp ORDER BY i DESC) AS rn FROM (SELECT t.i, {_fp_sql(p, o, 't', True)} AS fp FROM t)),
exact AS (SELECT fs.i AS si, ft.i AS ti FROM fs JOIN ft ON fs.fp = ft.fp AND fs.rn = ft.rn),
rs AS (SELECT * FROM s WHERE i NOT IN (SELECT si FROM exact)),
rt AS (SELECT * FROM t WHERE i NOT IN (SELECT ti FROM exact)),
cand AS ({met}),
scored AS (SELECT si, ti, round(({' + '.join(one(c) for c in names)}) / {len(names)}, 12) AS score FROM cand JOIN rs a ON a.i = si JOIN rt b ON b.i = ti),
best AS (SELECT si, ti, score FROM scored WHERE score > {o.threshold} QUALIFY row_number() OVER (PARTITION BY si ORDER BY score DESC, ti) = 1),
m AS (SELECT si, ti, score FROM best QUALIFY row_number() OVER (PARTITION BY ti ORDER BY score DESC, si) = 1),
d AS (SELECT 'unchanged' AS status, si, ti, NULL::DOUBLE AS score FROM exact
  UNION ALL SELECT 'modified', si, ti, score FROM m
  UNION ALL SELECT 'removed', i, NULL, NULL FROM rs WHERE i NOT IN (SELECT si FROM m)
  UNION ALL SELECT 'added', NULL, i, NULL FROM rt WHERE i NOT IN (SELECT ti FROM m))"""


def _row_score(c: str, a: str, b: str) -> str:
    """Similarity of two raw cells by the rule ``row``."""
    x, y = f"{a}.{c}", f"{b}.{c}"
    return f"CASE WHEN {x} = '' AND {y} = '' THEN 1.0::DOUBLE WHEN strlen({x}) <= 20 AND strlen({y}) <= 20 THEN jaro_winkler_similarity({x}, {y}) ELSE 1 - levenshtein({x}, {y}) / greatest(length({x}), length({y}))::DOUBLE END"


def _greedy_sql(p: Pair, o: DiffOptions, all_pairs: bool) -> str:
    """CTE ``m`` (si, ti, score): each source row in turn takes the last exact copy that is free, or else its best free partner."""
    names = _cols(p, o)
    met = "SELECT a.i AS si, b.i AS ti FROM s a, t b" if all_pairs else "\n UNION ".join(f"SELECT a.i AS si, b.i AS ti FROM s a JOIN t b ON a.{c} = b.{c} WHERE trim(a.{c}) <> ''" for c in names)
    strict = lambda c: f"CASE WHEN a.{c} = b.{c} THEN 1.0::DOUBLE ELSE jaro_winkler_similarity(a.{c}, b.{c}) END"
    one = " + ".join(_row_score(c, "a", "b") if all_pairs else strict(c) for c in names)
    same = " AND ".join(f"a.{c} = b.{c}" for c in names)
    return f"""WITH RECURSIVE {p.sql()},
met AS ({met}),
wish AS (
  SELECT si, ti, CASE WHEN {same} THEN NULL ELSE round(({one}) / {len(names)}, 12) END AS score FROM met JOIN s a ON a.i = si JOIN t b ON b.i = ti),
turn AS MATERIALIZED (SELECT i, row_number() OVER (ORDER BY i) AS n FROM s),
w AS MATERIALIZED (
  SELECT turn.n, si, ti, score, row_number() OVER (PARTITION BY si ORDER BY score IS NOT NULL, score DESC, CASE WHEN score IS NULL THEN -ti ELSE ti END) AS r
  FROM wish JOIN turn ON turn.i = si WHERE score IS NULL OR score > {o.threshold}),
g(n, taken, ti) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT
  UNION ALL
  SELECT n + 1, CASE WHEN ti IS NULL THEN taken ELSE list_append(taken, ti) END, ti FROM (
    SELECT g.n, g.taken, CAST(arg_min(w.ti, w.r) AS BIGINT) AS ti FROM g LEFT JOIN w ON w.n = g.n + 1 AND NOT list_contains(g.taken, w.ti)
    WHERE g.n < (SELECT count(*) FROM s) GROUP BY g.n, g.taken)),
m AS (SELECT turn.i AS si, g.ti, w.score FROM g JOIN turn USING (n) LEFT JOIN w ON w.n = g.n AND w.ti = g.ti)"""


# The queries.

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _key_options(keys: str, **changes: object) -> DiffOptions:
    return DiffOptions(mode="primary-key", key_columns=keys, **changes)


def _run(p: Pair, o: DiffOptions) -> Callable[[SparkSession, str], DiffResult]:
    return lambda spark, sf_dir: diff(*p.read(spark, sf_dir), o)


def _keyed_queries() -> None:
    o = _key_options("o_orderkey", **STRICT)
    orders = _run(ORDERS, o)
    base = _key_sql(ORDERS, o)
    _register("pk_status_counts", lambda s, d: orders(s, d).count_rows(), f"{base} {_COUNTS_SQL} d")
    for status, side in (("added", "t"), ("removed", "s"), ("unchanged", "s")):
        column = {"t": "target_row", "s": "source_row"}[side]
        names = ORDERS.target if side == "t" else ORDERS.source
        _register(
            f"pk_{status}",
            lambda s, d, status=status, column=column, names=tuple(names): orders(s, d).of(status).select("key", *[F.col(column)[n].alias(n) for n in names]),
            f"{base} SELECT key, {', '.join(f'{side}_{n} AS {n}' for n in names)} FROM d WHERE status = '{status}'",
        )
    _register("pk_modified", lambda s, d: orders(s, d).of("modified").select("key", "source_idx", "target_idx", F.size("differences").cast("long").alias("n_differences")),
              f"{base} SELECT key, s_i AS source_idx, t_i AS target_idx, CAST({' + '.join(f'CAST(s_{c} <> t_{c} AS INT)' for c in _O)} AS BIGINT) AS n_differences FROM d WHERE status = 'modified'")
    _register("pk_differences_flat", lambda s, d: orders(s, d).differences(), f"{base} {_flat_sql(ORDERS, o)}")
    _register("pk_differences_per_column", lambda s, d: orders(s, d).differences().groupBy("column").agg(F.count(F.lit(1)).alias("n")), f'{base} SELECT "column", count(*) AS n FROM ({_flat_sql(ORDERS, o)}) GROUP BY 1')
    two = _key_options("user_id, event_id", **STRICT)
    _register("pk_composite_key", lambda s, d: _run(EVENTS, two)(s, d).rows.select("status", "key"), f"{_key_sql(EVENTS, two)} SELECT status, key FROM d")
    _register("pk_excluded_columns", lambda s, d: _run(ORDERS, o.but(excluded_columns="o_orderstatus, o_totalprice"))(s, d).count_rows(), f"{_key_sql(ORDERS, o.but(excluded_columns=('o_orderstatus', 'o_totalprice')))} {_COUNTS_SQL} d")
    for name, flags in (
        ("pk_case_insensitive", {"case_sensitive": False, "ignore_whitespace": False, "ignore_empty_vs_null": False}),
        ("pk_ignore_whitespace", {"case_sensitive": True, "ignore_whitespace": True, "ignore_empty_vs_null": False}),
        ("pk_empty_vs_null", {"case_sensitive": True, "ignore_whitespace": False, "ignore_empty_vs_null": True}),
        ("pk_all_flags", {}),
    ):
        rule = _key_options("c_custkey", **flags)
        _register(name, lambda s, d, rule=rule: _run(CUSTOMER, rule)(s, d).rows.select("status", "key"), f"{_key_sql(CUSTOMER, rule)} SELECT status, key FROM d")
    _register("pk_flags_differences", lambda s, d: _run(CUSTOMER, _key_options("c_custkey"))(s, d).differences(), f"{_key_sql(CUSTOMER, _key_options('c_custkey'))} {_flat_sql(CUSTOMER, _key_options('c_custkey'))}")
    _register("pk_schema_mismatch", lambda s, d: _run(ORDERS_FEWER, o)(s, d).differences(), f"{_key_sql(ORDERS_FEWER, o)} {_flat_sql(ORDERS_FEWER, o)}")
    lines = Pair("lineitem", _L_INDEX, _plain("l_orderkey", "l_linenumber", "l_quantity"), _plain("l_orderkey", "l_linenumber", "l_quantity"), doubles=("l_quantity",))
    by_line = _key_options("l_orderkey, l_linenumber", **STRICT)
    _register("pk_duplicate_keys", lambda s, d: keyed.duplicate_keys(lines.read(s, d)[0], by_line).select("key", "n"),
              f"WITH {lines.sql()} SELECT l_orderkey || '|' || l_linenumber AS key, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1")
    by_user = _key_options("user_id", on_duplicate="last", **STRICT)
    last = lambda a: f"(SELECT * FROM {a} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)"
    plain = _key_sql(EVENTS, by_user)
    _register("pk_last_wins", lambda s, d: _run(EVENTS, by_user)(s, d).rows.selectExpr("status", "key", *_INDEXES),
              plain.replace("FROM s FULL JOIN t", f"FROM {last('s')} s FULL JOIN {last('t')} t") + " SELECT status, key, CAST(coalesce(s_i, -1) AS BIGINT) AS source_idx, CAST(coalesce(t_i, -1) AS BIGINT) AS target_idx FROM d")

    def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, target = ORDERS.read(spark, sf_dir)
        target = Dataset(numbered(target.df.drop(INDEX), INDEX, [F.col("c0").cast("long")]), target.headers)
        return Differ(source, target, o).chunk(100, 50).select("status", "key")

    base_chunk = _key_sql(ORDERS, o).replace("WHERE o_orderkey % 17 <> 0)", "WHERE o_orderkey % 17 <> 0 QUALIFY row_number() OVER (ORDER BY CAST(o_orderkey AS BIGINT)) BETWEEN 101 AND 150)")
    _register("pk_chunk", chunk, f"{base_chunk.replace('ORDER BY CAST(o_orderkey AS BIGINT)', 'ORDER BY ' + _O_NEW['o_orderkey'])} SELECT status, key FROM d WHERE status <> 'removed'")


    def last_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, target = ORDERS.read(spark, sf_dir)
        differ = Differ(source, Dataset(numbered(target.df.drop(INDEX), INDEX, [F.col("c0").cast("long")]), target.headers), o)
        return differ.chunk(differ.total - 50, 50).select("status", "key")

    _register("pk_last_chunk", last_chunk, f"""{_key_sql(ORDERS, o)} SELECT status, key FROM d WHERE status = 'removed'
UNION ALL SELECT status, key FROM (SELECT status, key FROM d WHERE status <> 'removed' ORDER BY CAST(key AS BIGINT) DESC LIMIT 50)""")

    def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The target arrives as CSV files, a few to a micro-batch."""
        source, target = ORDERS.read(spark, sf_dir)
        path = scratch(spark, "orders-stream")
        target.named().drop(INDEX).repartition(4, "o_orderkey").write.option("header", True).option("escape", '"').csv(f"{path}/in")
        differ = StreamingKeyDiff(source, target.headers, o, f"{path}/out")
        differ.start(stream_csv(spark, f"{path}/in", target.headers, files_per_batch=2)).awaitTermination()
        return differ.finish().select("status", "key")

    _register("stream_key_diff", streamed, f"{base} SELECT status, key FROM d")


def _content_queries() -> None:
    o = DiffOptions(**STRICT)
    base = _content_sql(SUPPLIERS, o)

    def rest(spark: SparkSession, sf_dir: str, p: Pair = SUPPLIERS, rule: DiffOptions = o) -> tuple[Dataset, Dataset]:
        source, target = p.read(spark, sf_dir)
        target = content.align_headers(source, target)
        exact = content.exact_phase(source, target, rule).where("s_idx is not null and t_idx is not null")
        return content._without(source, exact, "s_idx"), content._without(target, exact, "t_idx")

    def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, target = rest(spark, sf_dir)
        return content.scored_candidates(source, target, o).withColumn("score", F.round("score", 6))

    def best(spark: SparkSession, sf_dir: str) -> DataFrame:
        return content.best_targets(*rest(spark, sf_dir), o).select("source_idx", "target_idx", F.round("score", 6).alias("score"))

    def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
        return content.accepted(content.best_targets(*rest(spark, sf_dir), o)).select("source_idx", "target_idx", F.round("score", 6).alias("score"))

    shown = "si AS source_idx, ti AS target_idx, round(score, 6) AS score"
    _register("content_candidates", lambda s, d: content.candidate_pairs(*rest(s, d), o), f"{base} SELECT si AS source_idx, ti AS target_idx FROM cand")
    _register("content_scores", scores, f"{base} SELECT {shown} FROM scored")
    _register("content_best_match", best, f"{base} SELECT {shown} FROM best")
    _register("content_assignment", assignment, f"{base} SELECT {shown} FROM m")
    _register("content_status_counts", lambda s, d: _run(SUPPLIERS, o)(s, d).count_rows(), f"{base} {_COUNTS_SQL} d")
    label = "SELECT status, 'Row ' || (coalesce(si, ti) + 1) AS key, CAST(coalesce(si, -1) AS BIGINT) AS source_idx, CAST(coalesce(ti, -1) AS BIGINT) AS target_idx, round(coalesce(score, -1), 6) AS score FROM d"
    _register("content_rows", lambda s, d: _run(SUPPLIERS, o)(s, d).rows.selectExpr("status", "key", *_INDEXES, "round(coalesce(score, -1.0D), 6) as score"), f"{base} {label}")
    loose = DiffOptions(normalize_candidates=False)
    _register("content_default_flags", lambda s, d: _run(SUPPLIERS, loose)(s, d).rows.select("status", "key"), f"{_content_sql(SUPPLIERS, loose)} SELECT status, key FROM ({label})")
    _register("content_header_align", lambda s, d: _run(NATIONS, o)(s, d).rows.selectExpr("status", "key", *_INDEXES), f"{_content_sql(NATIONS, o)} SELECT status, key, source_idx, target_idx FROM ({label})")

    # The same over whole tables whose columns have common values: all pairs of a market segment or a brand are candidates.
    for name, p in (("content_customers", CUSTOMERS), ("content_parts", PARTS)):
        _register(name, lambda s, d, p=p: _run(p, o)(s, d).rows.selectExpr("status", "key", *_INDEXES, "round(coalesce(score, -1.0D), 6) as score"), f"{_content_sql(p, o)} {label}")

    greedy = o.but(strategy="greedy")
    whole = """ SELECT CASE WHEN ti IS NULL THEN 'removed' WHEN score IS NULL THEN 'unchanged' ELSE 'modified' END AS status, 'Row ' || (si + 1) AS key, si AS source_idx, CAST(coalesce(ti, -1) AS BIGINT) AS target_idx FROM m
UNION ALL SELECT 'added', 'Row ' || (i + 1), -1, i FROM t WHERE i NOT IN (SELECT ti FROM m WHERE ti IS NOT NULL)"""
    _register("content_greedy", lambda s, d: _run(SUPPLIERS, greedy)(s, d).rows.selectExpr("status", "key", *_INDEXES), _greedy_sql(SUPPLIERS, greedy, False) + whole)

    close = o.but(threshold=0.85)

    def in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Differ(*REGIONS.read(spark, sf_dir), close, StreamingConfig(chunk_size=9)).chunks().rows.selectExpr("status", "key", *_INDEXES)

    _register("content_chunks", in_chunks, f"""{_greedy_sql(REGIONS, close, True)}
 SELECT CASE WHEN ti IS NULL THEN 'removed' WHEN score IS NULL THEN 'unchanged' ELSE 'modified' END AS status,
  CASE WHEN ti IS NULL THEN 'Removed ' || row_number() OVER (PARTITION BY ti IS NULL, si // 9 ORDER BY si) ELSE 'Row ' || (si + 1) END AS key, CAST(si AS BIGINT) AS source_idx, CAST(coalesce(ti, -1) AS BIGINT) AS target_idx FROM m
UNION ALL SELECT 'added', 'Added ' || row_number() OVER (ORDER BY i), -1, i FROM t WHERE i NOT IN (SELECT ti FROM m WHERE ti IS NOT NULL)""")

    def bag(spark: SparkSession, sf_dir: str) -> DataFrame:
        return content.exact_phase(*LINES.read(spark, sf_dir), o).agg(
            F.count(F.when(F.col("s_idx").isNotNull() & F.col("t_idx").isNotNull(), 1)).alias("matched"),
            F.count(F.when(F.col("t_idx").isNull(), 1)).alias("source_left"), F.count(F.when(F.col("s_idx").isNull(), 1)).alias("target_left"),
        )

    names = ", ".join(LINES.source)
    _register("content_exact_bag", bag, f"""WITH {LINES.sql()},
a AS (SELECT {names}, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT {names}, count(*) AS n FROM t GROUP BY ALL)
SELECT CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS BIGINT) AS matched, CAST(sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)) AS BIGINT) AS source_left,
  CAST(sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)) AS BIGINT) AS target_left FROM a FULL JOIN b USING ({names})""")
    prints = lambda data, source: data.df.select(content.fingerprint_of(data, source, o).alias("fp"))

    def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        source, target = PARTS.read(spark, sf_dir)
        return prints(source, source), prints(target, source)

    both = f"WITH {PARTS.sql()}, a AS (SELECT {_fp_sql(PARTS, o, 's')} AS fp FROM s), b AS (SELECT {_fp_sql(PARTS, o, 't', True)} AS fp FROM t)"
    _register("content_except_all", lambda s, d: (lambda ab: ab[1].exceptAll(ab[0]))(sides(s, d)), f"{both} SELECT fp FROM b EXCEPT ALL SELECT fp FROM a")
    _register("content_removed_all", lambda s, d: (lambda ab: ab[0].exceptAll(ab[1]))(sides(s, d)), f"{both} SELECT fp FROM a EXCEPT ALL SELECT fp FROM b")
    _register("content_intersect_all", lambda s, d: (lambda ab: ab[0].intersectAll(ab[1]))(sides(s, d)), f"{both} SELECT fp FROM a INTERSECT ALL SELECT fp FROM b")


def _function_queries() -> None:
    o = DiffOptions()
    part = lambda s, d: s.read.parquet(f"{d}/part.parquet")
    cells = lambda: [F.col(c).cast("string") for c in _P]
    _register("fingerprint_rows", lambda s, d: part(s, d).select("p_partkey", fingerprint(cells(), o).alias("fp")),
              f"SELECT p_partkey, {' || chr(124) || chr(124) || '.join(f'({_norm(f'CAST({c} AS VARCHAR)', o)})' for c in _P)} AS fp FROM part")
    _register("fingerprint_groups", lambda s, d: part(s, d).groupBy(fingerprint(cells(), o).alias("fp")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("p_partkey"))[0].alias("first_key")),
              f"SELECT {' || chr(124) || chr(124) || '.join(f'({_norm(f'CAST({c} AS VARCHAR)', o)})' for c in _P)} AS fp, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1")
    _register("row_key", lambda s, d: part(s, d).select("p_partkey", row_key([F.col("p_brand"), F.col("p_type"), F.col("p_partkey").cast("string")]).alias("key")), "SELECT p_partkey, p_brand || '|' || p_type || '|' || p_partkey AS key FROM part")
    _register("normalized_values", lambda s, d: s.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey", f"{CUSTOMER.target['c_name']} as c_name", f"{CUSTOMER.target['c_mktsegment']} as seg").select("c_custkey", normalized(F.col("c_name"), o).alias("c_name"), normalized(F.col("seg"), o).alias("seg")),
              f"SELECT c_custkey, {_norm('c_name', o)} AS c_name, {_norm('seg', o)} AS seg FROM (SELECT c_custkey, {CUSTOMER.target['c_name']} AS c_name, {CUSTOMER.target['c_mktsegment']} AS seg FROM customer)")
    nation = lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.col("n_name").alias("b"))
    names = lambda s, d: part(s, d).select(F.col("p_name").alias("a"), (F.col("p_partkey") % 25).alias("n_nationkey")).join(nation(s, d), "n_nationkey").select("a", "b").distinct()
    pairs = "(SELECT DISTINCT p_name AS a, n_name AS b FROM part JOIN nation ON n_nationkey = p_partkey % 25)"
    _register("similarity_jaro_winkler", lambda s, d: names(s, d).select("a", "b", F.round(jaro_winkler(F.col("a"), F.col("b")), 6).alias("score")), f"SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS score FROM {pairs}")
    _register("similarity_levenshtein", lambda s, d: names(s, d).select("a", "b", F.round(normalized_levenshtein(F.col("a"), F.col("b")), 6).alias("score")), f"SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 6) AS score FROM {pairs}")
    rule = DiffOptions(similarity="row", **STRICT)

    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, target = SUPPLIERS.read(spark, sf_dir)
        same = source.df.select(F.col(INDEX).alias("source_idx")).join(target.df.select(F.col(INDEX).alias("target_idx")), F.col("source_idx") == F.col("target_idx"))
        return content.score_pairs(same, source, target, rule).select("source_idx", "target_idx", F.round("score", 6).alias("score"))

    one = lambda c: _row_score(c, "s", "t")
    _register("row_similarity", rows, f"WITH {SUPPLIERS.sql()} SELECT s.i AS source_idx, t.i AS target_idx, round(({' + '.join(one(c) for c in _S)}) / {len(_S)}, 6) AS score FROM s JOIN t ON s.i = t.i")

    def words(spark: SparkSession, sf_dir: str) -> DataFrame:
        both = part(spark, sf_dir).select("p_partkey", F.col("p_name").alias("old"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("new "), "p_name", F.lit(" end"))).otherwise(F.col("p_name")).alias("new"))
        d = both.select("*", word_diff(F.col("old"), F.col("new")).alias("d"))
        back = lambda flag: F.array_join(F.transform(F.filter("d", lambda x: ~x[flag]), lambda x: x["value"]), "")
        return d.select("p_partkey", back("added").alias("old"), back("removed").alias("new"), F.size(F.filter("d", lambda x: x["added"] | x["removed"])).cast("long").alias("n_changes"))

    _register("word_diff", words, "SELECT p_partkey, p_name AS old, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name || ' end' ELSE p_name END AS new, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 0 END::BIGINT AS n_changes FROM part")

    def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
        both = part(spark, sf_dir).select("p_partkey", F.col("p_name").alias("old"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("New "), F.upper("p_name"))).otherwise(F.upper("p_name")).alias("new"))
        d = both.select("*", word_diff(F.col("old"), F.col("new"), False).alias("d"))
        return d.select("p_partkey", F.array_join(F.transform(F.filter("d", lambda x: ~x["removed"]), lambda x: x["value"]), "").alias("new"), F.size(F.filter("d", lambda x: x["added"] | x["removed"])).cast("long").alias("n_changes"))

    _register("word_diff_case", folded, "SELECT p_partkey, lower(CASE WHEN p_partkey % 3 = 0 THEN 'New ' || p_name ELSE p_name END) AS new, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS n_changes FROM part")

    def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Whole texts against the texts of the next ids, which have nothing to do with them: both are rebuilt from the script."""
        texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("old"))
        d = texts.join(texts.select((F.col("doc_id") - 1).alias("doc_id"), F.col("old").alias("new")), "doc_id").select("doc_id", word_diff(F.col("old"), F.col("new")).alias("d"))
        digest = lambda flag: F.sha2(F.array_join(F.filter("d", lambda x: ~x[flag])["value"], "").cast("binary"), 256)
        return d.select("doc_id", digest("added").alias("old_sha256"), digest("removed").alias("new_sha256"))

    _register("word_diff_documents", documents, "SELECT a.doc_id, sha256(coalesce(a.text, '')) AS old_sha256, sha256(coalesce(b.text, '')) AS new_sha256 FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
    prints = " || chr(124) || chr(124) || ".join(f"({_norm(f'CAST({c} AS VARCHAR)', o)})" for c in _P)
    _register("fingerprint_hash_groups", lambda s, d: part(s, d).groupBy(fingerprint_hash(cells(), o)).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups")),
              f"SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM (SELECT {prints} AS fp FROM part) GROUP BY fp) GROUP BY n")

    def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The sum is exact at any size. It is a BIGINT as in the SQL while it fits one, else a decimal: the SQL has an error there."""
        key = F.col("l_partkey").cast("decimal(19,0)")
        total = settled(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.sum((key * key).cast("decimal(38,0)")).alias("sum_of_squares")))
        return total if (total.first()[0] or 0) >= 1 << 63 else total.select(F.col("sum_of_squares").cast("long"))

    _register("benchmark_parallel", squares, "SELECT CAST(sum(l_partkey * l_partkey) AS BIGINT) AS sum_of_squares FROM lineitem")


def _view_queries() -> None:
    o = _key_options("o_orderkey", **STRICT)
    view = lambda s, d: _run(ORDERS, o)(s, d).view()
    names = list(_O)
    new = lambda c: f"coalesce(t_{c}, s_{c})"
    text = "lower(concat_ws(' ', status, key, " + ", ".join(new(c) for c in names) + "))"
    base = _key_sql(ORDERS, o)
    shown = f"status, key, {', '.join(f'{new(c)} AS {c}' for c in names)}"
    for name, query, sql in (
        ("search_and", "modified urgent", f"contains({text}, 'modified') AND contains({text}, 'urgent')"),
        ("search_or", "added OR removed", f"contains({text}, 'added') OR contains({text}, 'removed')"),
        ("search_exclude", "-unchanged -urgent", f"NOT contains({text}, 'unchanged') AND NOT contains({text}, 'urgent')"),
        ("search_phrase", '"1-urgent" -unchanged', f"contains({text}, '1-urgent') AND NOT contains({text}, 'unchanged')"),
        ("search_column", "o_orderstatus:x o_orderpriority:low", f"contains(lower({new('o_orderstatus')}), 'x') AND contains(lower({new('o_orderpriority')}), 'low')"),
        ("search_groups", "added high OR removed low", f"(contains({text}, 'added') AND contains({text}, 'high')) OR (contains({text}, 'removed') AND contains({text}, 'low'))"),
    ):
        _register(name, lambda s, d, query=query: view(s, d).search(query).table(), f"{base} SELECT {shown} FROM d WHERE {sql}")
    _register("search_token_removed", lambda s, d: view(s, d).search(remove_token(parse_search("modified urgent -x"), 1)).table(), f"{base} SELECT {shown} FROM d WHERE contains({text}, 'modified') AND NOT contains({text}, 'x')")
    _register("view_shown_again", lambda s, d: view(s, d).hide("o_totalprice", "o_orderdate").show("o_orderdate").only_differences().table(), f"{base} SELECT * EXCLUDE (o_totalprice) FROM (SELECT {shown} FROM d WHERE status <> 'unchanged')")
    _register("view_union_columns", lambda s, d: _run(ORDERS_FEWER, o)(s, d).view().table(),
              f"{_key_sql(ORDERS_FEWER, o)} SELECT status, key, {new('o_orderkey')} AS o_orderkey, coalesce(t_o_orderdate, '') AS o_orderdate, {new('o_orderstatus').replace('t_o', 'CASE WHEN status = chr(117) THEN NULL ELSE t_o') .replace('o_orderstatus,', 'o_orderstatus END,', 1)} AS o_orderstatus, coalesce(s_o_custkey, '') AS o_custkey, coalesce(s_o_orderpriority, '') AS o_orderpriority FROM (SELECT * REPLACE (CASE WHEN status = 'unchanged' THEN '' ELSE t_o_orderdate END AS t_o_orderdate) FROM d)")
    _register("view_show_only_diffs", lambda s, d: view(s, d).only_differences().table(), f"{base} SELECT {shown} FROM d WHERE status <> 'unchanged'")
    _register("view_type_filter", lambda s, d: view(s, d).with_status("added").table(), f"{base} SELECT {shown} FROM d WHERE status = 'added'")
    _register("view_type_column_filter", lambda s, d: view(s, d).filter_type("MODIFIED").counts(), f"{base} {_COUNTS_SQL} d WHERE status = 'modified'")
    _register("view_column_filter", lambda s, d: view(s, d).filter_column("o_orderpriority", "URG").filter_column("o_orderstatus", "x").table(), f"{base} SELECT {shown} FROM d WHERE contains(lower({new('o_orderpriority')}), 'urg') AND contains(lower({new('o_orderstatus')}), 'x')")
    _register("view_counts_filtered", lambda s, d: view(s, d).search("urgent").with_status("added").counts(), f"{base} {_COUNTS_SQL} d WHERE contains({text}, 'urgent')")
    _register("view_hidden_columns", lambda s, d: view(s, d).hide("o_totalprice", "o_orderdate").only_differences().table(), f"{base} SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM (SELECT {shown} FROM d WHERE status <> 'unchanged')")
    rank = "CASE status WHEN 'modified' THEN 1 WHEN 'added' THEN 2 WHEN 'removed' THEN 3 ELSE 4 END"
    _register("view_default_order", lambda s, d: view(s, d).page(0, 40), f"{base} SELECT {shown} FROM d ORDER BY {rank}, coalesce(t_i, s_i) LIMIT 40")
    _register("view_sort_page", lambda s, d: view(s, d).only_differences().sort_by("o_totalprice", descending=True, numeric=True).sort_by("o_orderkey").page(20, 30),
              f"{base} SELECT {shown} FROM d WHERE status <> 'unchanged' ORDER BY CAST({new('o_totalprice')} AS DOUBLE) DESC, {new('o_orderkey')} LIMIT 30 OFFSET 20")
    price = f"CAST({new('o_totalprice')} AS DOUBLE)"
    deep = f"{base} SELECT {shown} FROM d {{}} ORDER BY {price} DESC, {new('o_orderkey')} LIMIT 50"
    stored = lambda s, d: view(s, d).sort_by("o_totalprice", descending=True, numeric=True).sort_by("o_orderkey").store(scratch(s, "orders-pages"))
    _register("view_deep_page", lambda s, d: stored(s, d).page(9000, 50), deep.format("") + " OFFSET 9000")
    _register("view_page_from", lambda s, d: stored(s, d).page_from("123456.5", 50), deep.format(f"WHERE {price} <= 123456.5"))
    _register("view_change_text", lambda s, d: (lambda v: v.rows.where("status = 'modified'").select("key", v.change_text("o_orderstatus").alias("change")))(view(s, d)), f"{base} SELECT key, CASE WHEN s_o_orderstatus <> t_o_orderstatus THEN s_o_orderstatus || ' → ' || t_o_orderstatus ELSE t_o_orderstatus END AS change FROM d WHERE status = 'modified'")

    def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _run(CUSTOMER, _key_options("c_custkey"))(spark, sf_dir).rows
        return encode_rows(rows).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("n_bytes"))

    def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rows encoded in tasks and decoded there again, each as a frame of its own."""
        rows = _run(CUSTOMER, _key_options("c_custkey"))(spark, sf_dir).rows

        @F.udf("key string, name string, n_differences long", useArrow=True)
        def decoded(status: str, data: bytes):
            found = decode_frame(frame_head({status: 1}) + bytes(data))[status][0]
            row = found.get("targetRow") or found.get("sourceRow") or found.get("row")
            return {"key": found["key"], "name": row["c_name"], "n_differences": len(found.get("differences", ()))}

        return encode_rows(rows).select("status", decoded("status", "data").alias("d")).select("status", "d.*")

    def written(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All classified orders, written as frames by the tasks that have them and read in tasks again."""
        path = scratch(spark, "orders-frames")
        write_frames(orders_of(spark, sf_dir).rows, path, 1 << 18)
        value = lambda row: F.element_at(row, "o_orderstatus")
        return read_frames(spark, path).select("status", "key", value("source_row").alias("old_status"), value("target_row").alias("new_status"), F.size("differences").cast("long").alias("n_differences"))

    def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Counts that come with the pass that writes the result, beside those of what is read again."""
        path = scratch(spark, "orders-result")
        counts = orders_of(spark, sf_dir).write(path)
        read = spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
        return read.select("status", "n", F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("status")).cast("long").alias("observed"))

    orders_of = _run(ORDERS, o)
    _register("written_counts", observed, f"{base} SELECT status, count(*) AS n, count(*) AS observed FROM d GROUP BY 1")
    _register("binary_frames", written, f"""{base} SELECT status, key, s_o_orderstatus AS old_status, CASE WHEN status <> 'unchanged' THEN t_o_orderstatus END AS new_status,
  CAST(CASE WHEN status = 'modified' THEN {' + '.join(f'CAST(s_{c} <> t_{c} AS INT)' for c in _O)} ELSE 0 END AS BIGINT) AS n_differences FROM d""")
    named = Pair("customer", "c_custkey", {"id": "concat('ID', c_custkey)", "seg": "c_mktsegment"}, {"id": "concat(CASE WHEN c_custkey % 2 = 0 THEN 'id' ELSE 'Id' END, c_custkey)", "seg": "c_mktsegment"})
    by_id = DiffOptions(mode="primary-key", key_columns=("id",), ignore_whitespace=False, ignore_empty_vs_null=False)
    digits = "list_transform(regexp_extract_all(lower({}), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(CAST(length(regexp_replace(x, '^0+([0-9])', '\\1')) AS VARCHAR), 9, '0') || regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END)".format(new("id"))
    _register("view_sort_natural", lambda s, d: _run(named, by_id)(s, d).view().sort_by("id", natural=True).page(30, 200), f"{_key_sql(named, by_id)} SELECT status, key, {new('id')} AS id, {new('seg')} AS seg FROM d ORDER BY {digits}, CASE status WHEN 'added' THEN 2 ELSE 3 END LIMIT 200 OFFSET 30")

    rule = _key_options("c_custkey")
    changed = " + ".join(f"CAST(({_norm(f's_{c}', rule)}) <> ({_norm(f't_{c}', rule)}) AS INT)" for c in _C)
    _register("binary_codec_read_back", read_back, f"{_key_sql(CUSTOMER, rule)} SELECT status, key, CASE WHEN status IN ('added', 'modified') THEN t_c_name ELSE s_c_name END AS name, CAST(CASE WHEN status = 'modified' THEN {changed} ELSE 0 END AS BIGINT) AS n_differences FROM d")
    as_json = lambda s, d: to_json(_run(CUSTOMER, rule)(s, d).rows).select(*[F.get_json_object("json", f"$.{x}").alias(y) for x, y in (("type", "status"), ("key", "key"), ("targetRow.c_name", "new_name"), ("row.c_name", "same_name"))])
    _register("json_rows", as_json, f"{_key_sql(CUSTOMER, rule)} SELECT status, key, CASE WHEN status IN ('added', 'modified') THEN t_c_name END AS new_name, CASE WHEN status = 'unchanged' THEN s_c_name END AS same_name FROM d")
    row = lambda a: "4 + " + " + ".join(f"8 + {len(c)} + strlen({a}_{c})" for c in _C)
    diffs = " + ".join(f"CASE WHEN ({_norm(f's_{c}', rule)}) <> ({_norm(f't_{c}', rule)}) THEN 12 + {len(c)} + strlen(s_{c}) + strlen(t_{c}) ELSE 0 END" for c in _C)
    _register("binary_codec_counts", frames, f"{_key_sql(CUSTOMER, rule)} SELECT status, count(*) AS n, CAST(sum(5 + strlen(key) + CASE status WHEN 'added' THEN {row('t')} WHEN 'modified' THEN {row('s')} + {row('t')} + 4 + {diffs} ELSE {row('s')} END) AS BIGINT) AS n_bytes FROM d GROUP BY 1")


def _source_queries() -> None:
    def trip(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, "nation-csv")
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet").repartitionByRange(3, "n_nationkey").sortWithinPartitions("n_nationkey")
        nation.write.option("header", True).csv(path)
        return read_csv(spark, path).named().select(F.col(INDEX).alias("row_idx"), "n_nationkey", "n_name", "n_regionkey")

    _register("csv_roundtrip", trip, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_idx, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")

    def sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, "region-csv")
        spark.read.parquet(f"{sf_dir}/region.parquet").repartitionByRange(2, "r_regionkey").sortWithinPartitions("r_regionkey").write.option("header", False).csv(path)
        return read_csv(spark, path, has_headers=True).named().select("Column1", "Column2")

    _register("header_sniff", sniff, "SELECT CAST(r_regionkey AS VARCHAR) AS Column1, r_name AS Column2 FROM region")

    def first_five(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, "nation-sample")
        spark.read.parquet(f"{sf_dir}/nation.parquet").repartitionByRange(3, "n_nationkey").sortWithinPartitions("n_nationkey").write.option("header", True).csv(path)
        names = ["n_nationkey", "n_name", "n_regionkey"]
        return spark.createDataFrame([[row[n] for n in names] for row in sample(read_csv(spark, path))], ", ".join(f"{n} string" for n in names))

    _register("csv_sample5", first_five, "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation ORDER BY nation.n_nationkey LIMIT 5")

    def many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A large table in many sorted files, read in splits."""
        path = scratch(spark, "orders-csv")
        names = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*names)
        orders.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", False).csv(path)
        read = read_csv(spark, path, has_headers=False).named()
        return read.select(*[F.col(f"Column{i + 1}").alias(n) for i, n in enumerate(names)])

    _register("csv_many_files", many_files, "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")

    def with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A large table in many sorted files that have a header each, read in splits; rows are numbered over all of them."""
        path = scratch(spark, "orders-with-headers")
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
        orders.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", True).csv(path)
        return read_csv(spark, path).named().withColumnRenamed(INDEX, "row_idx")

    _register("csv_folder_headers", with_headers, "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority FROM orders")

    def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Cells with line feeds and quotes: records that go on over a line's end."""
        path = scratch(spark, "customers-csv")
        note = F.concat(F.lit('say "'), "c_name", F.lit('",\n'), "c_mktsegment")
        spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("c_custkey"), note.alias("note")).repartitionByRange(4, "c_custkey").transform(lambda d: write_csv(d, path) or d)
        return read_csv(spark, path).named().drop(INDEX)

    _register("csv_quoted_lines", broken_lines, """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'say "' || c_name || '",' || chr(10) || c_mktsegment AS note FROM customer""")

    def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A stream of files in which some records have a cell too many: these are set aside, the rest is compared."""
        source, _ = ORDERS_FEWER.read(spark, sf_dir)
        path = scratch(spark, "ragged-stream")
        text = "concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 101 = 0 THEN 'EXTRA' END) as value"
        spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(4, "o_orderkey").selectExpr(text).write.text(f"{path}/in")
        live = StreamingKeyDiff(source, tuple(ORDERS_FEWER.source), _key_options("o_orderkey", **STRICT), f"{path}/out")
        live.start(stream_csv(spark, f"{path}/in", live.headers, has_headers=False, files_per_batch=2, on_ragged="reject")).awaitTermination()
        return live.finish().select("status", "key").unionByName(live.rejected().select(F.lit("rejected").alias("status"), F.col("text").alias("key")))

    _register("stream_ragged_records", ragged, """SELECT CASE WHEN o_orderkey % 101 = 0 THEN 'removed' ELSE 'unchanged' END AS status, CAST(o_orderkey AS VARCHAR) AS key FROM orders
UNION ALL SELECT 'rejected', concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority, 'EXTRA') FROM orders WHERE o_orderkey % 101 = 0""")

    def pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
        """CSV text that the driver holds, as a user pastes it: the five regions."""
        lines = [f'{r["r_regionkey"]},"{r["r_name"]}, ""{r["r_name"].lower()}"""' for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").collect()]
        return read_csv_text(spark, "\n".join(["id,note", *lines])).named().drop(INDEX)

    _register("csv_text", pasted, """SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name || ', "' || lower(r_name) || '"' AS note FROM region""")


_keyed_queries()
_content_queries()
_function_queries()
_view_queries()
_source_queries()
