"""Queries of corpus construction, files, JSON and streams."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from clausegrid.functions.text import bool_text
from clausegrid.operators import corpus as C, evidence as E, provenance as H, relational as A
from clausegrid.plans.fixtures import derived, fixture, with_fixtures
from clausegrid.storage import scratch
from clausegrid.sources import log as L, scans as S, sinks as K
from clausegrid.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, *fixtures: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_fixtures(sql, *fixtures)
        return f

    return add


def catalogs(spark, sf_dir):
    """Regions with nations as controls and suppliers as parts of parts."""
    s = derived(spark, sf_dir, "SELECT s_suppkey AS s, s_nationkey AS n, s_name AS name FROM supplier")
    leaf = s.select("n", "s", F.to_json(F.struct(F.concat(F.lit("N"), "n", F.lit("_smt."), "s").alias("id"), F.concat("s", F.lit(".")).alias("label"), F.col("name").alias("prose"))).alias("j"))
    parts = leaf.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "j"))), lambda x: x["j"]).alias("parts"))
    n = derived(spark, sf_dir, "SELECT n_nationkey AS n, n_name AS title, n_regionkey AS r FROM nation").join(parts, "n", "left")
    body = F.concat(F.lit('{"id":"N'), "n", F.lit('","title":"'), "title", F.lit('","parts":[{"id":"N'), "n", F.lit('_smt","name":"statement","parts":['), F.array_join(F.coalesce("parts", F.array().cast("array<string>")), ","), F.lit("]}]}"))
    groups = n.select("r", "n", body.alias("j")).groupBy("r").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "j"))), lambda x: x["j"]).alias("c"))
    return groups.select(F.col("r").alias("catalog"), F.concat(F.lit('{"groups":[{"controls":['), F.array_join("c", ","), F.lit("]}]}")).alias("json"))


@query("c01_catalog_walk", "SELECT n_regionkey AS catalog, 'N' || n_nationkey AS id, n_name AS title, 1 AS children FROM nation")
def _(spark, sf_dir):
    return C.walk(catalogs(spark, sf_dir), "parts").where("title IS NOT NULL").select("catalog", "id", "title", "children")


@query("c02_part_parents", "SELECT 'N' || s_nationkey || '_smt.' || s_suppkey AS id, 'N' || s_nationkey || '_smt' AS parent FROM supplier")
def _(spark, sf_dir):
    return C.walk(catalogs(spark, sf_dir), "parts").where("prose IS NOT NULL").select("id", "parent")


@query("c03_c04_clauses", "SELECT lower('N' || s_nationkey || '_smt.' || s_suppkey) AS id, s_name AS text, false AS used_descendants FROM supplier UNION ALL SELECT lower('N' || s_nationkey || '_smt'), string_agg(s_suppkey || '. ' || s_name, ' ' ORDER BY s_suppkey), true FROM supplier GROUP BY s_nationkey")
def _(spark, sf_dir):
    return C.emit_clauses(C.walk(catalogs(spark, sf_dir), "parts")).select("id", "text", "used_descendants")


@query("c05_parameters", "SELECT 'ac-' || k || '_odp.01' AS id, 'odp' AS kind, name || ' Choices: a; b' || CASE WHEN k % 2 = 0 THEN ' Guidelines: g' ELSE '' END AS text FROM fx_ids WHERE k % 3 <> 0", "ids")
def _(spark, sf_dir):
    none = F.array().cast("array<string>")
    p = fixture(spark, sf_dir, "ids").select(F.concat(F.lit("AC-"), "k", F.when(F.col("k") % 3 == 0, "_smt").otherwise("_odp.01")).alias("id"), F.col("name").alias("label"), F.array(F.lit("a"), F.lit("b")).alias("choices"), F.when(F.col("k") % 2 == 0, F.array(F.lit("g"))).otherwise(none).alias("guidelines"))
    return C.emit_parameters(p)


@query("c06_uncovered_gold", "SELECT DISTINCT lower(trim(raw)) AS id FROM fx_ids WHERE lower(trim(raw)) NOT IN (SELECT lower(id) FROM fx_clauses)", "ids", "clauses")
def _(spark, sf_dir):
    """Gold ids are all clause ids in capitals, which are covered, and identifiers as questions write them."""
    c = fixture(spark, sf_dir, "clauses")
    return C.uncovered(c.select(F.upper("id").alias("id")).unionByName(fixture(spark, sf_dir, "ids").select(F.col("raw").alias("id"))), c)


@query("c10_corpus_sanity", "SELECT count(*) AS n, count(*) FILTER (WHERE kind = 'smt') AS statements FROM fx_clauses", "clauses")
def _(spark, sf_dir):
    return C.sane(fixture(spark, sf_dir, "clauses"), 100)


@query("c11_parameter_key_map", "SELECT name AS key, min(raw) AS id FROM fx_ids GROUP BY name", "ids")
def _(spark, sf_dir):
    return C.key_map(fixture(spark, sf_dir, "ids").select(F.col("name").alias("key"), F.col("raw").alias("id")))


@query("s01_k01_json_lines", "SELECT id, kind, text FROM fx_clauses WHERE kind IN ('smt', 'gdn')", "clauses")
def _(spark, sf_dir):
    path = scratch(spark, "clauses")
    K.json_lines(fixture(spark, sf_dir, "clauses").select("id", "control_id", "kind", "text"), path)
    return S.clauses(spark, path).select("id", "kind", "text")


@query("s02_inventory_last_wins", "SELECT kind AS id, arg_max(title, k) AS title FROM fx_clauses GROUP BY kind", "clauses")
def _(spark, sf_dir):
    path = scratch(spark, "inventory")
    K.json_lines(fixture(spark, sf_dir, "clauses").select(F.col("kind").alias("id"), "title", F.col("k").alias("_ord")), path)
    return S.inventory(spark, path).select("id", "title")


@query("s03_strict_unique", "SELECT id, control_id FROM fx_clauses", "clauses")
def _(spark, sf_dir):
    return S.unique(fixture(spark, sf_dir, "clauses")).select("id", "control_id")


@query("s04_edges", "SELECT control_id AS parent, id, '' AS label FROM fx_clauses", "clauses")
def _(spark, sf_dir):
    return S.edges(fixture(spark, sf_dir, "clauses").select("id", F.col("control_id").alias("parent_part_id"), F.lit("").alias("label")))


@query("s07_k02_csv_round_trip", "SELECT CAST(item_id AS VARCHAR) AS query_key, text AS question FROM benchmark")
def _(spark, sf_dir):
    path = scratch(spark, "gold")
    K.csv(derived(spark, sf_dir, "SELECT item_id AS id, text AS question FROM benchmark"), path, ["id", "question"])
    return S.gold(spark, path).select("query_key", "question")


@query("s09_rewrite_lists", "SELECT CAST(conv_id AS VARCHAR) AS k, string_agg(text, '|' ORDER BY turn, text) AS texts FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def _(spark, sf_dir):
    path = scratch(spark, "rewrites")
    c = derived(spark, sf_dir, "SELECT conv_id, turn, text FROM conversations").where("text IS NOT NULL")
    empty = F.lit("")
    K.csv(c.select(F.lit("d").alias("dataset"), F.col("conv_id").cast("string").alias("query_id"), F.lit(1).alias("query_ord"), F.lit("q").alias("original_query"), F.col("turn").cast("int").alias("rewrite_rank"), F.col("text").alias("rewritten_query"),
                   empty.alias("model_id"), empty.alias("gen_params_json"), empty.alias("timestamp_et")), path, S.REWRITE.fieldNames())
    return S.rewrites(spark, path).select(F.col("query_id").alias("k"), F.array_join("rewrites", "|").alias("texts"))


# ---------------------------------------------------------------- files that the queries write first

NATIONS = "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation"


def nations(spark, sf_dir):
    """The 25 rows of a table of fixed size, for files that are made on the driver."""
    return derived(spark, sf_dir, NATIONS).orderBy("k").collect()


@query("s05_strict_json", "SELECT 'a.jsonl' AS name, 'jsonl' AS kind, count(*) AS n, 0 AS errors, 0 AS warnings FROM benchmark UNION ALL SELECT 'b.json', 'json', 1, 0, 0 UNION ALL SELECT 'c.jsonl', 'jsonl', 1, 3, 2 UNION ALL SELECT 'd.json', 'json', 0, 1, 0 UNION ALL SELECT 'e.jsonl', 'jsonl', 0, 1, 0")
def _(spark, sf_dir):
    path, rows = scratch(spark, "json"), derived(spark, sf_dir, "SELECT item_id AS id, text FROM benchmark").orderBy("id").toJSON().collect()  # a table of questions
    for name, data in (("a.jsonl", "".join(f"{r}\n" for r in rows).encode()), ("b.json", b'{"a": {"b": 1}}'), ("c.jsonl", b'\xef\xbb\xbf{"a": 1}\n{"a": 1, "a": 2}\n{"x": NaN}\n[1]'), ("d.json", b" \n"), ("e.jsonl", b"\xff\n")):
        K.write_bytes(spark, f"{path}/{name}", data)
    found = S.validated(spark, path)
    return found.select(F.substring_index("path", "/", -1).alias("name"), "kind", F.col("rows").alias("n"), F.size("errors").alias("errors"), F.size("warnings").alias("warnings"))


@query("s06_files", "SELECT 'below/n' || n_nationkey || '.jsonl' AS name, length(n_name) AS length FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, sf_dir):
    path = scratch(spark, "files")
    for r in nations(spark, sf_dir):
        K.write_bytes(spark, f"{path}/below/n{r['k']}.{'jsonl' if r['k'] % 2 == 0 else 'txt'}", r["name"].encode())
    return S.files(spark, path).select(F.substring_index("path", "/", -2).alias("name"), "length")


@query("s08_encoding_fallback", "SELECT n_name || 'é' AS question, CASE n_regionkey % 2 WHEN 0 THEN 'utf-8' ELSE 'latin-1' END AS written FROM nation")
def _(spark, sf_dir):
    path, out = scratch(spark, "encodings"), None
    for k, name in enumerate(("utf-8", "latin-1")):
        text = "id,question\n" + "".join(f"{r['k']},{r['name']}é\n" for r in nations(spark, sf_dir) if r["r"] % 2 == k)
        K.write_bytes(spark, f"{path}/{name}/g.csv", text.encode(name))
        one = S.gold(spark, f"{path}/{name}").select("question", F.lit(name).alias("written"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s10_yaml_profile", "SELECT 'ac-' || n_nationkey || '_odp.01' AS param, n_name || ': x' AS value FROM nation UNION ALL SELECT 'days', '30'")
def _(spark, sf_dir):
    path = scratch(spark, "profile")
    lines = "".join(f"  ac-{r['k']}_odp.01: \"{r['name']}: x\"  # given\n" for r in nations(spark, sf_dir))
    K.write_bytes(spark, f"{path}/p.yaml", f"name: none of these\nodp_values:\n{lines}  days: 30\n  several: [a, b]\n".encode())
    return S.profile(spark, path)


@query("s11_registry", "SELECT 'p' || n_nationkey AS param_id, n_name AS friendly_label FROM nation")
def _(spark, sf_dir):
    path = f"{scratch(spark, 'registry')}/r.json"
    data = "".join(f'{{"param_id": "p{r["k"]}", "friendly_label": "{r["name"]}"}}\n' for r in nations(spark, sf_dir)).encode()
    K.write_bytes(spark, path, data)
    return S.registry(spark, path, hashlib.sha256(data).hexdigest()).select("param_id", "friendly_label")


@query("s12_worksheet", "SELECT n_nationkey AS row, n_name || '|' || n_regionkey AS cells FROM nation")
def _(spark, sf_dir):
    path, rows = scratch(spark, "sheet"), nations(spark, sf_dir)
    cells = "".join(f'<row><c r="A{k + 1}" t="s"><v>{k}</v></c><c r="B{k + 1}"><v>{r["r"]}</v></c></row>' for k, r in enumerate(rows))
    data = K.archive({"xl/sharedStrings.xml": ('<sst xmlns="m">' + "".join(f"<si><t>{r['name']}</t></si>" for r in rows) + "</sst>").encode(), "xl/worksheets/sheet1.xml": f'<worksheet xmlns="m"><sheetData>{cells}</sheetData></worksheet>'.encode()})
    K.write_bytes(spark, f"{path}/w.xlsx", data)
    return S.worksheets(spark, path).select("row", F.array_join("cells", "|").alias("cells"))


@query("s13_k05_archive", "SELECT 'r' || n_regionkey || '.csv' AS member, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS line_no, n_name AS line FROM nation")
def _(spark, sf_dir):
    path, members = scratch(spark, "archive"), {}
    for r in nations(spark, sf_dir):
        members[f"r{r['r']}.csv"] = members.get(f"r{r['r']}.csv", b"") + r["name"].encode() + b"\n"
    K.write_bytes(spark, f"{path}/a.zip", K.archive(members | {"other.txt": b"x"}))
    return S.zip_members(spark, path, r"\.csv$").select("member", "line_no", "line")


@query("s14_call_log", "SELECT CAST(o_orderkey AS VARCHAR) AS response_id, o_orderstatus AS content FROM orders")
def _(spark, sf_dir):
    path, text = scratch(spark, "calls"), F.col("k").cast("string")
    o = derived(spark, sf_dir, "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders")
    K.json_lines(o.select(F.lit("v1").alias("schema_version"), text.alias("response_id"), text.alias("query_id"), F.lit("m").alias("model_id"), F.col("s").alias("content")), path)
    return S.call_log(spark, path, "v1").select("response_id", "content")


@query("s15_contexts", "SELECT CAST(item_id AS VARCHAR) AS query_id, item_id % 4 <> 0 AS valid FROM benchmark")
def _(spark, sf_dir):
    """Contexts whose hash is that of their canonical text; some questions change after that."""
    path = scratch(spark, "contexts")
    b = derived(spark, sf_dir, "SELECT item_id AS k, text FROM benchmark").select(F.col("k").cast("string").alias("query_id"), F.col("text").alias("question"), "k")
    text = F.to_json(F.struct("query_id", "question"))
    hashed = b.withColumn("context_sha256", F.sha2(text, 256)).withColumn("question", F.when(F.col("k") % 4 == 0, F.concat("question", F.lit("?"))).otherwise(F.col("question")))
    K.json_lines(hashed.select("query_id", "question", "context_sha256"), path)
    return S.contexts(spark, path).select("query_id", "valid")


@query("k04_replaced_log", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def _(spark, sf_dir):
    path, rows = f"{scratch(spark, 'log')}/calls", derived(spark, sf_dir, NATIONS).select("k", "name")
    K.replace_log(rows.where("k < 9"), path)
    K.replace_log(rows.where("k >= 9"), path)
    return spark.read.schema(rows.schema).json(path)


@query("k04_committed_log", "SELECT o_orderkey AS k, o_orderstatus AS s, o_orderkey % 3 AS part FROM orders")
def _(spark, sf_dir):
    """Three batches, one of them sent twice."""
    path, rows = f"{scratch(spark, 'log')}/calls", derived(spark, sf_dir, "SELECT o_orderkey AS k, o_orderstatus AS s, o_orderkey % 3 AS part FROM orders")
    for part in (0, 1, 1, 2):
        L.append(rows.where(F.col("part") == part), path, f"part {part}")
    return L.read(spark, path, rows.schema)


@query("k06_report", "SELECT string_agg(line, chr(10) ORDER BY o) AS report FROM (SELECT -2 AS o, '| k | share |' AS line UNION ALL SELECT -1, '| --- | --- |' UNION ALL SELECT n_nationkey, '| ' || n_nationkey || ' | ' || printf('%.4f', n_nationkey / 8.0) || ' |' FROM nation)")
def _(spark, sf_dir):
    rows = derived(spark, sf_dir, NATIONS).orderBy("k").select("k", (F.col("k") / 8.0).cast("double").alias("share"))
    return spark.createDataFrame([(K.markdown(rows),)], "report string")


@query("k07_no_overwrite", "SELECT count(*) AS n, true AS refused FROM nation")
def _(spark, sf_dir):
    path, rows = scratch(spark, "kept"), derived(spark, sf_dir, NATIONS)
    K.json_lines(rows.select("k"), path)
    try:
        K.json_lines(rows.select("name"), path)
        refused = False
    except AnalysisException as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.json(path).agg(F.count("k").alias("n")).withColumn("refused", F.lit(refused))


@query("p05_unknown_mode_keeps_all", "SELECT q, count(DISTINCT id) AS n FROM fx_retrieved WHERE kind IN ('smt', 'gdn') GROUP BY q", "retrieved")
def _(spark, sf_dir):
    return A.counted(E.by_mode(fixture(spark, sf_dir, "retrieved"), "no such mode"), ["q"])


@query("o15_profile_fingerprint", """SELECT k, sha256('{"a":{"z":"' || name || 'é"},"n":' || k || '}') AS sha256 FROM fx_ids""", "ids")
def _(spark, sf_dir):
    profile = F.concat(F.lit('{"n": '), "k", F.lit(', "a": {"z": "'), "name", F.lit('é"}}'))
    return fixture(spark, sf_dir, "ids").select("k", H.profile_fingerprint(profile).alias("sha256"))


@query("h02_h05_manifest", "SELECT 'n' || n_nationkey || '.txt' AS name, length(n_name) AS length, sha256(n_name) AS sha256 FROM nation")
def _(spark, sf_dir):
    path = scratch(spark, "outputs")
    for r in nations(spark, sf_dir):
        K.write_bytes(spark, f"{path}/files/n{r['k']}.txt", r["name"].encode())
    written = H.write_manifest(spark, f"{path}/files", f"{path}/manifest")
    return written.select(F.substring_index("path", "/", -1).alias("name"), "length", "sha256")


@query("k03_resume", "SELECT doc_id AS k FROM documents WHERE doc_id % 3 <> 0")
def _(spark, sf_dir):
    d = derived(spark, sf_dir, "SELECT doc_id AS k, lang FROM documents")
    return K.remaining(d, d.where("k % 3 = 0"), "k", ("lang",)).select("k")


@query("t30_narrow_booleans", "SELECT doc_id AS k, toxic = 1 AS b FROM labels")
def _(spark, sf_dir):
    return derived(spark, sf_dir, "SELECT doc_id AS k, toxic FROM labels").select("k", bool_text(F.col("toxic").cast("string"), ("1", "true")).alias("b"))


@query("t32_column_aliases", "SELECT conv_id AS id, text AS question FROM conversations")
def _(spark, sf_dir):
    rows = derived(spark, sf_dir, "SELECT conv_id, text FROM conversations")
    return S.aliased(rows, {"id": ("query_id", "conv_id"), "question": ("q", "text")}).select("id", "question")


@query("t34_first_object", "SELECT event_id AS k, CASE WHEN event_id % 2 = 0 THEN '{\"a\": \"}{\", \"b\": ' || event_id || '}' END AS found FROM events")
def _(spark, sf_dir):
    e = derived(spark, sf_dir, "SELECT event_id AS k FROM events")
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit('noise { bad {"a": "}{", "b": '), "k", F.lit("} tail }"))).otherwise("no object {")
    return e.select("k", S.first_objects(text).alias("found"))


@query("t38_flattened_json", "SELECT event_id AS k, 'm.k' AS path, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number FROM events UNION ALL SELECT event_id, 'm.deep.value', value FROM events UNION ALL SELECT event_id, 'n', 1.5 FROM events")
def _(spark, sf_dir):
    """The events' properties, nested with a value below them and beside a number."""
    e = derived(spark, sf_dir, "SELECT event_id AS k, CAST(get_json_object(props, '$.k') AS BIGINT) AS p, value FROM events")
    text = F.to_json(F.struct(F.struct(F.col("p").alias("k"), F.struct(F.col("value")).alias("deep"), F.lit("word").alias("w")).alias("m"), F.lit(1.5).alias("n")))
    return A.flat_numbers(e.select("k", text.alias("j")), ["k"], "j")


@query("st01_stream_append", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf_dir):
    schema, out = spark.read.parquet(f"{sf_dir}/events.parquet").schema, scratch(spark, "stream")
    stream = jobs.files(spark, sf_dir, schema, "events*")
    jobs.each_batch(stream, lambda df: df.select("event_id", "event_type"), f"{out}/rows", "event_id", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"))
