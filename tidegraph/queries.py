"""Registered queries over the triple views, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.windows import POLICIES
from .sources import generate
from .sources.ntriples import parse_lines, work_folder
from .sources.views import EVENTS_SQL, INTEGER, ORDERS_SQL, STATIC_SQL, events_view, orders_view, triples_events, triples_static
from .streaming import StreamEngine

_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _engine(spark: SparkSession, triples) -> StreamEngine:
    engine = StreamEngine(spark)
    engine.register_stream("<http://ex/stream>", triples)
    return engine


def text(where: str, window: str = "1d TUMBLING", select: str = "*") -> str:
    return f"PREFIX ex: <http://ex/> SELECT {select} FROM STREAM <http://ex/stream> RANGE {window} WHERE {{ {where} }} "


def _ms(x: str) -> int:
    unit = x.lstrip("0123456789")
    return int(x.removesuffix(unit)) * _MS[unit]


def windows_sql(window: str, policy: str = "reference") -> str:
    """The triples of ``triples_events`` with their windows, as table ``w``."""
    if window.startswith("TRIPLES"):
        return f"WITH {EVENTS_SQL}, w AS MATERIALIZED (SELECT *, seq // {window.split()[1]} AS win_id FROM tr)"
    parts = window.split()
    size = _ms(parts[0])
    step = _ms(parts[2]) if len(parts) == 3 else size
    due = lambda t: f"CASE WHEN {t}-t0 < {size} THEN 0 ELSE ({t}-t0-{size})//{step}+1 END"
    low, high = f"CASE WHEN ts_ms-t0 < {size} THEN 0 ELSE (ts_ms-t0-{size})//{step}+1 END", f"least((ts_ms-t0)//{step}, kmax)"
    last = {"reference": f"CASE WHEN {due('t1')} = {due('t2')} THEN {due('t1')} ELSE {due('t1')} - 1 END", "always": due("t1"), "never": f"{due('t1')} - 1"}[policy]
    return f"""WITH {EVENTS_SQL}, b AS MATERIALIZED (SELECT arg_min(ts_ms, seq) t0, arg_max(ts_ms, seq) t1, (SELECT ts_ms FROM tr ORDER BY seq DESC LIMIT 1 OFFSET 1) t2 FROM tr),
k AS MATERIALIZED (SELECT t0, {last} AS kmax FROM b),
tw AS MATERIALIZED (SELECT s, p, o, {low} AS lo, {high} AS hi FROM tr, k),
w AS MATERIALIZED (SELECT CAST(n.i AS BIGINT) + lo AS win_id, s, p, o FROM tw JOIN range({-(-size // step)} + 1) n(i) ON lo + n.i <= hi)"""


def of(p: str, s: str = "e", o: str = "x", where: str = "TRUE") -> str:
    """The bindings of ``?s ex:p ?o``."""
    return f"(SELECT win_id, s AS {s}, o AS {o} FROM w WHERE p = '<http://ex/{p}>' AND {where})"


def _windowed(name: str, where: str, sql: str, window: str = "1d TUMBLING", select: str = "*", policy: str = "reference") -> None:
    query = text(where, window, select)
    _QUERIES[name] = lambda spark, d: _engine(spark, events_view(spark, d)).sql(query, final_partial=policy)
    _SQL[name] = f"{windows_sql(window, policy)} {sql}"


def _whole(name: str, view: Callable, where: str, sql: str) -> None:
    _QUERIES[name] = lambda spark, d: _engine(spark, view(spark, d)).match(text(where))
    _SQL[name] = sql


_T = "<http://ex/type/{}>".format
_U7, _E5, _E0 = "<http://ex/user/7>", "<http://ex/event/5>", "<http://ex/event/0>"
_ERR = of("type", where=f"o = '{_T('error')}'")
_NUM = "TRY_CAST(regexp_extract(o, '^\"([^\"]*)\"', 1) AS DOUBLE)"

for _name, _where, _sql in (
    ("select_s", f"{_E5} ?p ?o", f"SELECT win_id, p, o FROM w WHERE s = '{_E5}'"),
    ("select_p", "?s ex:type ?o", "SELECT win_id, s, o FROM w WHERE p = '<http://ex/type>'"),
    ("select_o", f"?s ?p {_U7}", f"SELECT win_id, s, p FROM w WHERE o = '{_U7}'"),
    ("select_sp", f"{_E5} ex:user ?o", f"SELECT win_id, o FROM w WHERE s = '{_E5}' AND p = '<http://ex/user>'"),
    ("select_so", f"{_E0} ?p {_T('error')}", f"SELECT win_id, p FROM w WHERE s = '{_E0}' AND o = '{_T('error')}'"),
    ("select_po", f"?s ex:user {_U7}", f"SELECT win_id, s FROM w WHERE p = '<http://ex/user>' AND o = '{_U7}'"),
    ("select_all", "?s ?p ?o", "SELECT win_id, s, p, o FROM w"),
    ("select_ground", f"{_E0} ex:type {_T('error')} . ?s ex:user {_U7}", f"SELECT a.win_id, a.s FROM w a JOIN w g USING (win_id) WHERE a.p = '<http://ex/user>' AND a.o = '{_U7}' AND g.s = '{_E0}' AND g.p = '<http://ex/type>' AND g.o = '{_T('error')}'"),
):
    _windowed(_name, _where, _sql, "40d TUMBLING")

_whole("select_repeated_var", triples_static, "?x ex:knows ?x", f"WITH {STATIC_SQL} SELECT s AS x FROM st WHERE p = '<http://ex/knows>' AND s = o")
_whole("select_unwindowed_orders", orders_view, "?k ex:status <http://ex/status/F> . ?k ex:customer ?c", f"WITH {ORDERS_SQL} SELECT a.s AS k, b.o AS c FROM tr a JOIN tr b ON a.s = b.s WHERE a.p = '<http://ex/status>' AND a.o = '<http://ex/status/F>' AND b.p = '<http://ex/customer>'")
_windowed("join_star2", "?e ex:type ?t . ?e ex:user ?u", f"SELECT win_id, e, t, u FROM {of('type', o='t')} JOIN {of('user', o='u')} USING (win_id, e)")
_windowed("join_star3", "?e ex:type ?t . ?e ex:user ?u . ?e ex:value ?v", f"SELECT win_id, e, t, u, v FROM {of('type', o='t')} JOIN {of('user', o='u')} USING (win_id, e) JOIN {of('value', o='v')} USING (win_id, e)")
_windowed("join_two_keys", "?e ?p ?o . ?e ?q ?o", "SELECT a.win_id, a.s AS e, a.p, a.o, b.p AS q FROM w a JOIN w b ON a.win_id = b.win_id AND a.s = b.s AND a.o = b.o")
_windowed("join_three_keys", "?e ?p ?o . ?e ?p ?o", "SELECT a.win_id, a.s AS e, a.p, a.o FROM w a JOIN w b ON a.win_id = b.win_id AND a.s = b.s AND a.p = b.p AND a.o = b.o")
_SIX = [(k, f"<http://ex/event/{k}>") for k in range(4)]
_MANY = " . ".join(f"{e} ex:user ?u{k} . {e} ex:type ?t{k} . {e} ex:value ?v{k}" for k, e in _SIX)
_MANY_SQL = "SELECT win_id, " + ", ".join(f"u{k}, t{k}, v{k}" for k, _ in _SIX) + " FROM " + " JOIN ".join(f"(SELECT win_id, o AS {v}{k} FROM w WHERE s = '{e}' AND p = '<http://ex/{p}>')" + (" USING (win_id)" if k or v != "u" else "") for k, e in _SIX for v, p in (("u", "user"), ("t", "type"), ("v", "value")))
_windowed("join_twelve_keys", f"{{ {_MANY} }} {{ {_MANY} }}", _MANY_SQL)
_whole("join_chain", triples_static, "?c ex:nation ?n . ?n ex:region ?r . ?r ex:name ?m", f"WITH {STATIC_SQL} SELECT a.s AS c, a.o AS n, b.o AS r, x.o AS m FROM st a JOIN st b ON a.o = b.s JOIN st x ON b.o = x.s WHERE a.p = '<http://ex/nation>' AND b.p = '<http://ex/region>' AND x.p = '<http://ex/name>'")
_windowed("product", f"?a ex:type {_T('error')} . ?b ex:user {_U7}", f"SELECT win_id, a, b FROM {of('type', 'a', where=f"o = '{_T('error')}'")} JOIN {of('user', 'b', where=f'''o = '{_U7}' ''')} USING (win_id)")
_windowed("nested_group", "?e ex:user ?u . { ?e ex:type ?t . ?e ex:value ?v }", f"SELECT win_id, e, u, t, v FROM {of('user', o='u')} JOIN (SELECT * FROM {of('type', o='t')} JOIN {of('value', o='v')} USING (win_id, e)) USING (win_id, e)")
_windowed("optional", f"?e ex:user ?u OPTIONAL {{ ?e ex:type {_T('error')} . ?e ex:value ?v }}", f"SELECT win_id, e, u, v FROM {of('user', o='u')} LEFT JOIN (SELECT win_id, e, v FROM {_ERR} JOIN {of('value', o='v')} USING (win_id, e)) USING (win_id, e)")
_windowed("optional_product", f"?a ex:user {_U7} OPTIONAL {{ ?b ex:user <http://ex/user/8> }}", f"SELECT win_id, a, b FROM {of('user', 'a', where=f'''o = '{_U7}' ''')} LEFT JOIN {of('user', 'b', where='''o = '<http://ex/user/8>' ''')} USING (win_id)", "6h TUMBLING")
_windowed("optional_filter_scope", "?e ex:type ?t OPTIONAL { ?e ex:value ?v FILTER ( ?v > 5000 ) }", f"SELECT win_id, e, t, v FROM {of('type', o='t')} LEFT JOIN {of('value', o='v', where=f'{_NUM} > 5000')} USING (win_id, e)")
_HALF = lambda v, t: f"(SELECT win_id, {v}, u FROM {of('type', v, where=f'''o = '{_T(t)}' ''')} LEFT JOIN {of('user', v, 'u', f'''o < '<http://ex/user/2>' ''')} USING (win_id, {v}))"
_windowed("optional_then_join_unbound", "{ ?e ex:type <http://ex/type/error> OPTIONAL { ?e ex:user ?u FILTER ( ?u < <http://ex/user/2> ) } } { ?f ex:type <http://ex/type/signup> OPTIONAL { ?f ex:user ?u FILTER ( ?u < <http://ex/user/2> ) } }", f"SELECT a.win_id, e, a.u, f FROM {_HALF('e', 'error')} a JOIN {_HALF('f', 'signup')} b ON a.win_id = b.win_id AND a.u IS NOT DISTINCT FROM b.u", "1h TUMBLING")
_windowed("union_same", f"{{ ?e ex:type {_T('error')} }} UNION {{ ?e ex:type {_T('click')} }}", f"SELECT win_id, s AS e FROM w WHERE o = '{_T('error')}' UNION ALL SELECT win_id, s FROM w WHERE o = '{_T('click')}'")
_windowed("union_diff", f"{{ ?e ex:type {_T('error')} . ?e ex:user ?u }} UNION {{ ?e ex:value ?v }}", f"SELECT win_id, e, u, NULL AS v FROM {_ERR} JOIN {of('user', o='u')} USING (win_id, e) UNION ALL SELECT win_id, e, NULL, v FROM {of('value', o='v')}")
_windowed("union_three", f"{{ ?e ex:type {_T('error')} }} UNION {{ ?f ex:type {_T('click')} }} UNION {{ ?e ex:user ?f }}", f"SELECT win_id, s AS e, NULL AS f FROM w WHERE o = '{_T('error')}' UNION ALL SELECT win_id, NULL, s FROM w WHERE o = '{_T('click')}' UNION ALL SELECT win_id, s, o FROM w WHERE p = '<http://ex/user>'")
_windowed("optional_union", f"?e ex:type {_T('error')} OPTIONAL {{ ?e ex:user ?u }} UNION {{ ?e ex:value ?v }}", f"SELECT win_id, e, u, v FROM {_ERR} LEFT JOIN (SELECT win_id, e, u, NULL AS v FROM {of('user', o='u')} UNION ALL SELECT win_id, e, NULL, v FROM {of('value', o='v')}) USING (win_id, e)")

for _n, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _cents = 224 if _n in ("eq", "ne") else 5000
    _windowed(f"filter_num_{_n}", f"?e ex:value ?v FILTER ( ?v {_op} {_cents} )", f"SELECT win_id, s AS e, o AS v FROM w WHERE p = '<http://ex/value>' AND {_NUM} {_op} {_cents}")
    _windowed(f"filter_uri_{_n}", f"?e ex:type ?t FILTER ( ?t {_op} {_T('error')} )", f"SELECT win_id, s AS e, o AS t FROM w WHERE p = '<http://ex/type>' AND o {_op} '{_T('error')}'")
_ANY = "SELECT win_id, s AS e, p, o FROM w WHERE "
_ISNUM = f"starts_with(o, '\"') AND {_NUM}"
_windowed("filter_and", "?e ex:value ?v FILTER ( ( ?v > 1000 ) && ( ?v < 5000 ) )", f"SELECT win_id, s AS e, o AS v FROM w WHERE p = '<http://ex/value>' AND {_NUM} > 1000 AND {_NUM} < 5000")
_windowed("filter_or", f"?e ?p ?o FILTER ( ( ?o > 9000 ) || ( ?o = {_T('click')} ) )", f"{_ANY} ({_ISNUM} > 9000) OR o = '{_T('click')}'")
_windowed("filter_not_mixed", "?e ?p ?o FILTER ( !( ?o > 5000 ) )", f"{_ANY} NOT coalesce({_ISNUM} > 5000, FALSE)")
_windowed("filter_precedence", f"?e ?p ?o FILTER ( ?o = {_T('click')} || ?o > 1000 && ?o < 2000 )", f"{_ANY} o = '{_T('click')}' OR ({_ISNUM} > 1000 AND {_NUM} < 2000)")
_windowed("filter_type_mismatch", "?e ?p ?o FILTER ( ?o != 5000 )", f"{_ANY} coalesce({_ISNUM} <> 5000, FALSE)")
_windowed("filter_bound", f"?e ex:user ?u OPTIONAL {{ ?e ex:type {_T('error')} . ?e ex:value ?v }} FILTER ( !( bound( ?v ) ) )", f"SELECT win_id, e, u, CAST(NULL AS VARCHAR) AS v FROM {of('user', o='u')} a WHERE NOT EXISTS (SELECT 1 FROM {_ERR} b WHERE a.win_id = b.win_id AND a.e = b.e)")
_windowed("filter_var_var", f"?e ex:user {_U7} . ?e ex:value ?v . ?f ex:user <http://ex/user/8> . ?f ex:value ?x FILTER ( ?v < ?x )", f"SELECT win_id, e, v, f, x FROM (SELECT a.win_id, a.e, v FROM {of('user', where=f'''o = '{_U7}' ''')} a JOIN {of('value', o='v')} USING (win_id, e)) JOIN (SELECT a.win_id, a.f, y.x FROM {of('user', 'f', 'z', '''o = '<http://ex/user/8>' ''')} a JOIN {of('value', 'f')} y USING (win_id, f)) USING (win_id) WHERE {_NUM.replace('(o,', '(v,')} < {_NUM.replace('(o,', '(x,')}", "2d TUMBLING")
_whole("filter_string", triples_static, '?r ex:name ?m FILTER ( ?m >= "ASIA" )', f"WITH {STATIC_SQL} SELECT s AS r, o AS m FROM st WHERE p = '<http://ex/name>' AND regexp_extract(o, '\"(.*)\"', 1) >= 'ASIA'")
_windowed("project_reorder", "?e ex:type ?t . ?e ex:user ?u", f"SELECT win_id, u, e FROM {of('type', o='t')} JOIN {of('user', o='u')} USING (win_id, e)", select="?u ?e")

_ERRORS = f"?e ex:type {_T('error')} . ?e ex:user ?u"
_ERRORS_SQL = f"SELECT win_id, e, u FROM {_ERR} JOIN {of('user', o='u')} USING (win_id, e)"
for _n, _w in (("tumbling", "1d TUMBLING"), ("sliding", "2d STEP 1d"), ("sliding_fine", "6h STEP 1h"), ("gap", "1h STEP 1d"), ("count", "TRIPLES 1000"), ("ms", "43200000ms TUMBLING"), ("s", "172800s STEP 86400s"), ("m", "90m STEP 720m")):
    _windowed(f"window_{_n}", _ERRORS, _ERRORS_SQL, _w)
for _n in POLICIES:
    _windowed(f"window_partial_{_n}", "?e ex:user ?u", f"SELECT win_id, e, u FROM {of('user', o='u')}", "4d STEP 3d", policy=_n)

_QUERIES["window_arrival"] = lambda spark, d: _engine(spark, events_view(spark, d)).sql(text(_ERRORS, "1d STEP 12h"), mode="arrival")
_SQL["window_arrival"] = f"""WITH {EVENTS_SQL}, b AS (SELECT min(ts_ms) t0 FROM tr),
c AS (SELECT tr.*, t0, greatest(0, -((-(ts_ms-t0+1-86400000) - CASE WHEN ts_ms-t0+1-86400000 > 0 THEN 43199999 ELSE 0 END)//43200000)) AS due FROM tr, b),
m AS (SELECT *, seq + min(due - seq) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM c),
l AS (SELECT max(m) AS last, max(m) FILTER (seq < (SELECT max(seq) FROM tr)) AS prev FROM m),
tw AS (SELECT s, p, o, UNNEST(range(m, least((ts_ms-t0+43200000)//43200000 - 1, CASE WHEN last = prev THEN last ELSE last-1 END)+1)) AS win_id FROM m, l),
w AS (SELECT * FROM tw) {_ERRORS_SQL}"""

_QUERIES["found_counts"] = lambda spark, d: _engine(spark, events_view(spark, d)).found(text(_ERRORS, "2d STEP 1d"))
_SQL["found_counts"] = f"{windows_sql('2d STEP 1d')} SELECT win_id, count(*) AS found FROM ({_ERRORS_SQL}) GROUP BY win_id"


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, events_view(spark, sf_dir))
    engine.register_query("daily", text(_ERRORS))
    engine.register_query("thousands", text(_ERRORS, "TRIPLES 1000"))
    a, b = (df.withColumn("query", F.lit(n)) for n, df in engine.run_batch().items())
    return a.unionByName(b)


_QUERIES["multi_query"] = _multi
_SQL["multi_query"] = f"SELECT *, 'daily' AS query FROM ({windows_sql('1d TUMBLING')} {_ERRORS_SQL}) UNION ALL SELECT *, 'thousands' FROM ({windows_sql('TRIPLES 1000')} {_ERRORS_SQL})"
_windowed("combined", f"?e ex:type ?t . ?e ex:value ?v FILTER ( ?v > 5000 && ?t != {_T('view')} ) OPTIONAL {{ ?e ex:user ?u FILTER ( ?u < <http://ex/user/2> ) }}", f"SELECT win_id, e, t, v, u FROM {of('type', o='t', where=f'''o <> '{_T('view')}' ''')} JOIN {of('value', o='v', where=f'{_NUM} > 5000')} USING (win_id, e) LEFT JOIN {of('user', o='u', where='''o < '<http://ex/user/2>' ''')} USING (win_id, e)", "2d STEP 1d")


def _streamed(name: str, window: str, policy: str) -> None:
    """The query over a stream of files in several batches, with what is open reported at the end."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        where = work_folder(spark, name)
        rows = triples_events(spark, sf_dir)
        total = rows.agg(F.max("seq")).first()[0]
        for k in range(3):  # files in order of arrival
            rows.where(F.expr(f"seq * 3 div {total + 1} = {k}")).coalesce(1).write.mode("append").parquet(f"{where}/in")
        live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
        engine = _engine(spark, live)
        engine.register_query("q", text(_ERRORS, window), final_partial=policy)
        sink = lambda df, n: df.write.mode("overwrite").parquet(f"{where}/out/batch={n}")
        t0 = rows.agg(F.min_by("ts_ms", "seq")).first()[0]
        engine.start("q", sink, t0, f"{where}/state", trigger={"availableNow": True}).awaitTermination()
        engine.flush("q", sink, t0, f"{where}/state")
        return spark.read.schema("win_id long, e string, u string").parquet(f"{where}/out").select("win_id", "e", "u")

    _QUERIES[name] = run
    _SQL[name] = f"{windows_sql(window, policy)} {_ERRORS_SQL}"


_streamed("streaming_sliding", "2d STEP 1d", "always")
_streamed("streaming_gap", "1h STEP 1d", "reference")
_streamed("streaming_count", "TRIPLES 1000", "reference")


def _lines(spark: SparkSession, sf_dir: str, unit: str = "ms") -> DataFrame:
    at = F.expr(f"ts_ms div {1 if unit == 'ms' else 1000}")
    rows = triples_events(spark, sf_dir).select(F.format_string("%s %s %s . %d", "s", "p", "o", at).alias("value"))
    return parse_lines(rows, unit=unit).select("s", "p", "o", "ts_ms")


_QUERIES["source_lines"] = _lines
_SQL["source_lines"] = f"WITH {EVENTS_SQL} SELECT s, p, o, ts_ms FROM tr"
_QUERIES["source_lines_seconds"] = lambda spark, d: _lines(spark, d, "s")
_SQL["source_lines_seconds"] = f"WITH {EVENTS_SQL} SELECT s, p, o, ts_ms // 1000 * 1000 AS ts_ms FROM tr"
_INT = "'<http://example.org/int/'||{}||'>'".format
_QUERIES["generate_modular"] = lambda spark, d: generate.modular(spark, 5000, 97)
_SQL["generate_modular"] = f"SELECT {_INT('i%97')} AS s, {_INT('(2*i)%97')} AS p, {_INT('(5*i)%97')} AS o, (i+1)*1000 AS ts_ms, i AS seq FROM range(5000) t(i)"


def _uniform_sql(i: str, seed: int, salt: int, limit: int) -> str:
    """``generate.uniform``, as one element of a list that each round maps."""
    prime = generate.PRIME
    out = f"[(CAST({i} AS BIGINT) % {prime} * 48271 + {(seed * 69621 + salt * 16807 + 1) % prime}) % {prime}]"
    for by in generate.ROUNDS:
        out = f"list_transform({out}, lambda x: (x * ((x + {by}) % {prime}) + {by}) % {prime})"
    return f"({out}[1] % {limit})"


def _drawn_sql(n: int, limit: int, seed: int, salt: int, s: str | None = None, o: str | None = None) -> str:
    """The rows of ``generate._drawn``; its order is that of MD5."""
    room = limit ** (3 - (s is not None) - (o is not None))
    have = 2 * n + 100 if room > 4 * n else 40 * n + 1000
    terms = [_INT(_uniform_sql("i", seed, salt + k, limit)) for k in range(3)]
    return f"(SELECT s, p, o FROM (SELECT DISTINCT {s or terms[0]} AS s, {terms[1]} AS p, {o or terms[2]} AS o FROM range({have}) t(i)) ORDER BY md5(s||' '||p||' '||o||' {seed}'), s, p, o LIMIT {n})"


def _generated(name: str, make: Callable[[SparkSession], DataFrame], seed: int, *parts: str) -> None:
    _QUERIES[name] = lambda spark, d: make(spark).select("s", "p", "o", "seq", "ts_ms")
    rows = " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)
    _SQL[name] = f"SELECT s, p, o, seq, (seq + 1) * 1000 AS ts_ms FROM (SELECT s, p, o, row_number() OVER (ORDER BY md5(s||' '||p||' '||o||' {seed}'), s, p, o) - 1 AS seq FROM ({rows}))"


_HIT, _SUBJECT = _INT(generate.SELECT_OBJECT), _INT(generate.JOIN_SUBJECT)
_NUMBER = f"'\"'||{_uniform_sql('i', 11, 19, 3000)}||'\"^^<{INTEGER}>'"
_generated("generate_random", lambda s: generate.random_triples(s, 2000, 50, 11), 11, _drawn_sql(2000, 50, 11, 0))
_generated("generate_select", lambda s: generate.select_workload(s, 300, 5000, 11), 11, _drawn_sql(300, 20000, 11, 10, o=_HIT), _drawn_sql(4700, 20000, 11, 0))
_generated("generate_join", lambda s: generate.join_workload(s, 300, 5000, 1000, 11), 11, _drawn_sql(1, 1000, 11, 30, _SUBJECT, _HIT), _drawn_sql(299, 1000, 11, 10, o=_HIT), _drawn_sql(299, 1000, 11, 20, s=_SUBJECT), _drawn_sql(4401, 1000, 11, 0))
_generated("generate_filter", lambda s: generate.filter_workload(s, 700, 5000, 11), 11, _drawn_sql(700, 2000, 11, 10, o=_NUMBER), _drawn_sql(4300, 2000, 11, 0))
_QUERIES["generate_dedup"] = lambda spark, d: generate.dedup_shuffle(generate.modular(spark, 5000, 97), 3)
_SQL["generate_dedup"] = f"SELECT DISTINCT s, p, o FROM ({_SQL['generate_modular']})"
_QUERIES["generate_timestamps"] = lambda spark, d: generate.append_timestamps(generate.modular(spark, 5000, 97).drop("ts_ms", "seq"))
_SQL["generate_timestamps"] = f"SELECT s, p, o, seq, ts_ms FROM ({_SQL['generate_modular']})"
_QUERIES["generate_padded"] = lambda spark, d: generate.pad(generate.modular(spark, 4000, 97), 5000, 3)
_SQL["generate_padded"] = f"SELECT s, p, o FROM ({_SQL['generate_modular']}) WHERE seq < 4000 UNION ALL SELECT {', '.join(_INT(_uniform_sql('i', 3, k, 500)) + f' AS {c}' for k, c in enumerate('spo'))} FROM range(1000) t(i)"
_QUERIES["generate_literals"] = lambda spark, d: generate.inject_literals(generate.modular(spark, 5000, 97), 10, 3)
_SQL["generate_literals"] = f"SELECT CASE WHEN seq % 10 = 0 THEN {_INT(generate.LITERAL_SUBJECT)} ELSE s END AS s, p, CASE WHEN seq % 10 = 0 THEN '\"'||({_uniform_sql('seq', 3, 5, 20)} + 1)||'\"^^<{INTEGER}>' ELSE o END AS o, ts_ms, seq FROM ({_SQL['generate_modular']})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


FLAGSHIP = "combined"
