"""Log parsing, file classes, references and symbols: conversations stand for logs, documents and parts for source files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import normal_command
from millrace.operators import repo, rules, sessions, surface
from millrace.report import bundle, tokens
from millrace.sources import transcripts
from millrace.sources.tables import table
from millrace.streaming import usage as usage_stream

QUERIES, SQL = {}, {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see; one of this machine only where the session runs on it alone."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return (held or tempfile.mkdtemp(prefix="millrace-")).rstrip("/")


def query(name: str, sql: str):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of session logs, as a reader of files gives them: every other conversation has the file name of the one before, in another project.

    Each turn has its text, thoughts, a call and a result; counters drift in type; after some turns come lines that aren't events.
    """
    turn, conv = F.col("turn"), F.col("conv_id")
    whole = lambda x: F.floor(x).cast("int")
    call = F.struct(F.lit("tool_use").alias("type"), F.when(turn % 3 != 2, "Read").alias("name"), F.struct(F.concat(F.lit("/w/f"), whole(turn / 6).cast("string")).alias("file_path"), F.concat(F.lit("run   "), whole(turn / 6).cast("string")).alias("command")).alias("input"))
    call = F.when(turn % 3 != 2, F.to_json(call)).otherwise(F.to_json(F.struct(F.lit("tool_use").alias("type"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit("run   "), whole(turn / 6).cast("string")).alias("command")).alias("input"))))
    long = (conv % 10 == 0) & (turn % 4 == 1)
    result = F.repeat(F.lit("x"), F.when(long, 60_000).otherwise(turn % 5).cast("int"))
    text = F.coalesce(F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1), F.lit('""'))
    blocks = F.concat(F.lit('[{"type":"text","text":'), text, F.lit('},{"type":"thinking","thinking":"hm"},7,'), call, F.lit(',{"type":"tool_result","is_error":'), (turn % 4 == 0).cast("string"), F.lit(',"content":"'), result, F.lit('"}]'))
    usage = F.concat(F.lit('{"input_tokens":"'), (turn * 1000).cast("string"), F.lit('","output_tokens":'), (turn * 10).cast("string"), F.lit('.9,"cache_read_input_tokens":'), (turn * F.when(conv % 3 == 0, 4000).otherwise(700)).cast("string"), F.lit("}"))
    head = F.concat(F.lit('{"type":"'), F.col("role"), F.lit('","cwd":"/w/'), (conv % 4).cast("string"), F.lit('","version":"1.'), turn.cast("string"), F.lit('","timestamp":"'), turn.cast("string"), F.lit('","gitBranch":"b'), (turn % 2).cast("string"))
    compact = F.when(turn.isin(2, 6), F.lit('","isCompactSummary":true')).otherwise('"')
    event = F.concat(head, compact, F.lit(',"message":{"content":'), blocks, F.lit(',"usage":'), usage, F.lit("}}"))
    odd = F.array(F.lit("{not json"), F.lit("  "), F.lit("[1,2]"), F.lit("7"), F.lit('{"type":"note"}'))
    lines = F.when(turn % 3 == 1, F.concat(F.array(event), odd)).otherwise(F.array(event))
    rows = table(spark, sf_dir, "conversations").where("turn is not null")
    path = F.concat(F.lit("file:/logs/-home-my app%"), (conv % 2).cast("string"), F.lit("/c"), whole(conv / 2).cast("string"), F.lit(".jsonl"))
    return rows.select(path.alias("path"), F.lit(0).alias("block"), turn.alias("turn"), F.posexplode(lines).alias("n", "value")).select("value", "path", "block", (F.col("turn") * 10 + F.col("n")).cast("bigint").alias("line"))


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parsed(log_lines(spark, sf_dir))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logged(spark, sf_dir)
    return sessions.session_metrics(transcripts.turns(found), transcripts.session_attributes(found))


_TURNS = """named AS (SELECT *, 'file:/logs/-home-my app%' || conv_id % 2 || '/c' || conv_id // 2 || '.jsonl' AS path FROM conversations WHERE turn IS NOT NULL),
t AS (SELECT path, conv_id, turn AS seq, role, length(coalesce(text, '')) AS text_chars, CASE WHEN conv_id % 10 = 0 AND turn % 4 = 1 THEN 60000 ELSE turn % 5 END AS result_chars, turn % 4 = 0 AS failed, turn IN (2, 6) AS compact,
  CASE WHEN role = 'assistant' THEN turn * 1000 ELSE 0 END AS i, CASE WHEN role = 'assistant' THEN turn * 10 ELSE 0 END AS o, CASE WHEN role = 'assistant' THEN turn * CASE WHEN conv_id % 3 = 0 THEN 4000 ELSE 700 END ELSE 0 END AS r
  FROM named WHERE role IN ('assistant', 'user'))"""
_SESSIONS = f"""{_TURNS}, s AS (SELECT path, count(*) AS turns, count_if(role = 'assistant')::BIGINT AS assistant_turns, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o, sum(r)::BIGINT AS r, count_if(failed)::BIGINT AS tool_errors,
  count_if(result_chars >= 60000)::BIGINT AS big_outputs, count_if(compact)::BIGINT AS compactions FROM t GROUP BY path),
calls AS (SELECT path, seq // 6 AS item, seq % 3 <> 2 AS is_read, count(*) AS n FROM t GROUP BY ALL),
extra AS (SELECT path, coalesce(sum(n - 1) FILTER (is_read AND n >= 3), 0)::BIGINT AS reread_extra, coalesce(sum(n - 1) FILTER (NOT is_read AND n >= 2), 0)::BIGINT AS repeat_extra FROM calls GROUP BY 1),
b AS (SELECT path, 'c' || any_value(conv_id) // 2 AS session_id, '/w/' || any_value(conv_id) % 4 AS repo, '1.' || min(turn) AS version, 'b' || max(turn) % 2 AS branch, CAST(min(turn) AS VARCHAR) AS started, CAST(max(turn) AS VARCHAR) AS ended FROM named WHERE role IS NOT NULL GROUP BY 1),
m AS (SELECT *, CASE WHEN i + r = 0 THEN 0.0 ELSE r::DOUBLE / (i + r) END AS ratio, round_even(tool_errors::DOUBLE / turns, 4) AS denial_ratio, 300 * i + 1500 * o + 30 * r AS cost8 FROM s JOIN extra USING (path) JOIN b USING (path)),
c AS (SELECT *, cost8 // 10000 + CASE WHEN cost8 % 10000 > 5000 OR (cost8 % 10000 = 5000 AND (cost8 // 10000) % 2 = 1) THEN 1 ELSE 0 END AS cost4,
  CASE WHEN ratio < 0.55 THEN 270 * i // 10000 + CASE WHEN 270 * i % 10000 > 5000 OR (270 * i % 10000 = 5000 AND (270 * i // 10000) % 2 = 1) THEN 1 ELSE 0 END ELSE 0 END AS waste4 FROM m)"""


@query("parsed_turns", f"WITH {_TURNS} SELECT path, 'c' || conv_id // 2 AS session_id, seq, role, '/w/' || conv_id % 4 AS cwd, text_chars, 2::BIGINT AS thinking_chars, i AS input_tokens, o AS output_tokens, r AS cache_read_tokens, failed::BIGINT AS tool_errors, result_chars, compact AS is_compaction FROM t")
def parsed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transcripts.turns(logged(spark, sf_dir))
    chars = F.aggregate("tool_result_chars", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("result_chars")
    return found.select("path", "session_id", F.floor(F.col("seq.line") / 10).alias("seq"), "role", "cwd", "text_chars", "thinking_chars", "input_tokens", "output_tokens", "cache_read_tokens", "tool_errors", chars, "is_compaction")


@query(
    "parsed_sessions",
    f"""WITH {_SESSIONS} SELECT path, session_id, turns, assistant_turns, i AS input_tokens, tool_errors, big_outputs, compactions, reread_extra, repeat_extra, repo, version, branch, started, ended,
  round_even(ratio, 4) AS cache_hit_ratio, denial_ratio, cost4 / 10000.0 AS est_cost_usd, waste4 / 10000.0 AS cache_waste_usd FROM c""",
)
def parsed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = [F.col(c).cast("double").alias(c) for c in ("est_cost_usd", "cache_waste_usd")]
    return metrics(spark, sf_dir).select("path", "session_id", "turns", "assistant_turns", "input_tokens", "tool_errors", "big_outputs", "compactions", F.col("reread_files_extra").alias("reread_extra"), F.col("repeated_cmds_extra").alias("repeat_extra"), "repo", "version", "branch", "started", "ended", "cache_hit_ratio", "denial_ratio", *money)


@query("log_lines_read", f"WITH {_TURNS} SELECT path, sum(CASE WHEN turn % 3 = 1 THEN 2 ELSE 1 END)::BIGINT AS events FROM named GROUP BY path")
def log_lines_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logged(spark, sf_dir).groupBy("path").agg(F.count("*").alias("events"))


@query(
    "tool_calls_read",
    f"""WITH {_TURNS} SELECT path, seq, CASE WHEN seq % 3 <> 2 THEN 'Read' ELSE 'Bash' END AS name, CASE WHEN seq % 3 <> 2 THEN '/w/f' || seq // 6 END AS file_path, 'run ' || seq // 6 AS command FROM t""",
)
def tool_calls_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transcripts.turns(logged(spark, sf_dir)).select("path", F.floor(F.col("seq.line") / 10).alias("seq"), F.inline("tool_calls"))
    return found.withColumn("command", normal_command(F.col("command")))


_FOUND = f"""{_SESSIONS}, n AS (SELECT count(*) AS sessions, sum(waste4)::BIGINT / 10000.0 AS waste, round_even(sum(r)::DOUBLE / (sum(i) + sum(r)), 4) AS ratio, count_if(reread_extra > 0)::BIGINT AS again, sum(big_outputs)::BIGINT AS big,
  count_if(repeat_extra > 0)::BIGINT AS loops, count_if(denial_ratio > 0.04)::BIGINT AS denied, count_if(compactions >= 2)::BIGINT AS thrash FROM c),
few AS (SELECT path FROM c WHERE reread_extra > 0 ORDER BY path LIMIT 5), files AS (SELECT path, item, n, row_number() OVER (PARTITION BY path ORDER BY n DESC, item) AS k FROM calls WHERE is_read AND n >= 3 AND path IN (SELECT path FROM few)),
x AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS extra FROM files WHERE k <= 2),
f AS (SELECT 'cache-hit-ratio' AS id, CASE WHEN ratio >= 0.55 THEN 'low' WHEN waste >= 1 THEN 'high' ELSE 'medium' END AS severity, 0 AS n, round_even(waste, 2) AS impact_usd FROM n WHERE waste > 0 AND (ratio < 0.55 OR waste >= 0.5)
UNION ALL SELECT 'file-reread-churn', 'medium', again, round_even(round_even(4000 * extra / 4.0, 0) * 3.0 / 1e6, 2) FROM n, x WHERE again > 0
UNION ALL SELECT 'oversized-tool-output', 'medium', big, round_even(round_even(60000 * big / 4.0, 0) * 3.0 / 1e6, 2) FROM n WHERE big > 0
UNION ALL SELECT 'command-retry-loops', 'low', loops, 0 FROM n WHERE loops > 0
UNION ALL SELECT 'permission-and-error-friction', 'low', denied, 0 FROM n WHERE denied > 0
UNION ALL SELECT 'context-thrash', 'medium', thrash, 0 FROM n WHERE thrash > 0)"""


@query("log_findings", f"WITH {_FOUND} SELECT id, severity, n, impact_usd::DOUBLE AS impact_usd FROM f")
def log_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.token_findings(metrics(spark, sf_dir).persist(), [F.col("path")])
    n = F.when(F.col("id") == "cache-hit-ratio", 0).otherwise(F.regexp_extract("evidence", r"^(\d+) ", 1).try_cast("bigint"))
    return found.select("id", "severity", n.cast("bigint").alias("n"), "impact_usd")


@query(
    "finding_order",
    f"""WITH {_FOUND} SELECT row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, impact_usd DESC, list_position(['cache-hit-ratio', 'file-reread-churn', 'oversized-tool-output', 'command-retry-loops', 'permission-and-error-friction', 'context-thrash'], id)) AS rank, id FROM f""",
)
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.token_findings(metrics(spark, sf_dir).persist(), [F.col("path")])
    return found.select(F.row_number().over(Window.orderBy(*rules.by_impact())).cast("bigint").alias("rank"), "id")


@query(
    "cache_evidence",
    f"""WITH {_SESSIONS}, worst AS (SELECT left(session_id, 8) || ' (' || CAST(round_even(round_even(ratio, 4) * 100, 0) AS INTEGER) || '%)' AS w, row_number() OVER (ORDER BY waste4 DESC, path) AS k FROM c WHERE waste4 > 0)
SELECT CAST(round_even(round_even(sum(r)::DOUBLE / (sum(i) + sum(r)), 4) * 100, 0) AS INTEGER) || '% of context came from the cache (aim: 55%); ' || count_if(waste4 > 0) || ' of ' || count(*) || ' sessions are below it. Worst: '
  || (SELECT string_agg(w, ', ' ORDER BY k) FROM worst WHERE k <= 3) || '.' AS evidence FROM c HAVING sum(waste4) > 0 AND (round_even(sum(r)::DOUBLE / (sum(i) + sum(r)), 4) < 0.55 OR sum(waste4) >= 5000)""",
)
def cache_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.token_findings(metrics(spark, sf_dir).persist(), [F.col("path")]).where("id = 'cache-hit-ratio'").select("evidence")


_KPI = f"""{_SESSIONS}, n AS (SELECT count(*) AS n, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o, sum(r)::BIGINT AS r, sum(cost4)::BIGINT AS c4, sum(waste4)::BIGINT AS w4, round_even(sum(r)::DOUBLE / (sum(i) + sum(r)), 4) AS ratio FROM c),
k AS (SELECT *, round_even(c4 / 10000.0, 2)::DOUBLE AS usd, round_even(w4 / 10000.0, 2)::DOUBLE AS lost FROM n), e AS (SELECT *, 60 * ratio + 40 * (1 - least(1.0, lost / usd)) AS score FROM k),
human AS (SELECT *, CASE WHEN i < 1000 THEN i::VARCHAR WHEN i < 1000000 THEN round_even(i / 1000.0, 0)::INT || 'K' ELSE round_even(i / 1000000.0, 0)::INT || 'M' END AS hi, CASE WHEN o < 1000 THEN o::VARCHAR WHEN o < 1000000 THEN round_even(o / 1000.0, 0)::INT || 'K' ELSE round_even(o / 1000000.0, 0)::INT || 'M' END AS ho FROM e)"""


@query(
    "token_measures",
    f"""WITH {_KPI} SELECT 'Sessions' AS label, n::VARCHAR AS value, NULL AS role FROM human UNION ALL SELECT 'Estimated cost', '$' || format('{{:,.2f}}', usd), NULL FROM human
UNION ALL SELECT 'Cache hit ratio', round_even(100 * ratio, 0)::INT || '%', CASE WHEN ratio >= 0.55 THEN 'good' ELSE 'high' END FROM human UNION ALL SELECT 'To save (cache)', '$' || format('{{:,.2f}}', lost), CASE WHEN lost >= 0.01 THEN 'medium' ELSE 'good' END FROM human
UNION ALL SELECT 'Tokens in / out', hi || ' / ' || ho, NULL FROM human UNION ALL SELECT 'Grade', CASE WHEN score >= 90 THEN 'A' WHEN score >= 78 THEN 'B' WHEN score >= 62 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END, NULL FROM human""",
)
def token_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and the grade of the token report's bundle."""
    made = bundle.token_bundle(tokens.report(metrics(spark, sf_dir)))
    rows = [(k["label"], k["value"], k.get("role")) for k in made["kpis"]] + [("Grade", made["verdict"]["grade"], None)]
    return spark.createDataFrame(rows, "label string, value string, role string")


@query("worst_sessions_shown", f"""WITH {_SESSIONS}, w AS (SELECT path, session_id, round_even(least(100.0, (CASE WHEN round_even(ratio, 4) < 0.55 THEN 34.0 * (1 - round_even(ratio, 4) / 0.55) ELSE 0.0 END) + least(20, 6 * reread_extra) + least(16, 8 * big_outputs)
  + least(14, 7 * repeat_extra) + (CASE WHEN denial_ratio > 0.04 THEN least(10.0, 200 * denial_ratio) ELSE 0.0 END) + least(6, 3 * greatest(0, compactions - 1))), 1) AS waste_score FROM c)
SELECT left(session_id, 24) AS label, waste_score AS value, CASE WHEN waste_score >= 30 THEN 'high' WHEN waste_score >= 15 THEN 'medium' ELSE 'low' END AS role FROM (SELECT * FROM w ORDER BY waste_score DESC, path LIMIT 8)""")
def worst_sessions_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of the token report's chart."""
    held = metrics(spark, sf_dir).withColumn("mtime", F.lit(0).cast("timestamp"))
    rows = bundle.token_bundle(tokens.report(held))["charts"][0]["rows"]
    return spark.createDataFrame([(r["label"], float(r["value"]), r["role"]) for r in rows], "label string, value double, role string")


@query(
    "streamed_usage",
    f"WITH {_TURNS} SELECT path, session_id, i AS input_tokens, o AS output_tokens, r AS cache_read_tokens, 0::BIGINT AS cache_creation_tokens FROM (SELECT path, 'c' || any_value(conv_id) // 2 AS session_id, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o, sum(r)::BIGINT AS r FROM t GROUP BY path)",
)
def streamed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of sessions from a stream of their log lines, all that is there taken at once."""
    lines = log_lines(spark, sf_dir)
    stored = f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    lines.write.parquet(f"{stored}/lines")
    stream = spark.readStream.schema(lines.schema).parquet(f"{stored}/lines")
    name = f"usage_{uuid.uuid4().hex}"
    query_ = usage_stream.session_usage(transcripts.parsed(stream)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{stored}/state").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.table(name).withColumn("session_id", transcripts.stem(F.col("path")))


def log_folder(spark: SparkSession, sf_dir: str) -> str:
    """The lines as files, one a project, in a folder a project; all of a project's conversations are one session there."""
    root = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    lines = log_lines(spark, sf_dir).select("value", F.element_at(F.split("path", "/"), -2).alias("project"))
    lines.repartition("project").write.partitionBy("project").text(root)
    return root


_WRITTEN = f"""{_TURNS}, w AS (SELECT 'project=-home-my app%25' || conv_id % 2 AS project, * FROM t), calls AS (SELECT project, seq // 6 AS item, seq % 3 <> 2 AS is_read, count(*) AS n FROM w GROUP BY ALL),
extra AS (SELECT project, coalesce(sum(n - 1) FILTER (is_read AND n >= 3), 0)::BIGINT AS reread_extra, coalesce(sum(n - 1) FILTER (NOT is_read AND n >= 2), 0)::BIGINT AS repeat_extra FROM calls GROUP BY 1),
s AS (SELECT project, count(*) AS turns, count_if(role = 'assistant')::BIGINT AS assistant_turns, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, count_if(failed)::BIGINT AS tool_errors, count_if(result_chars >= 60000)::BIGINT AS big_outputs, count_if(compact)::BIGINT AS compactions FROM w GROUP BY 1)
SELECT * FROM s JOIN extra USING (project)"""


def _written(metrics_: DataFrame) -> DataFrame:
    project = F.element_at(F.split("path", "/"), -2).alias("project")
    return metrics_.select(project, "turns", "assistant_turns", "input_tokens", "output_tokens", "tool_errors", "big_outputs", "compactions", F.col("reread_files_extra").alias("reread_extra"), F.col("repeated_cmds_extra").alias("repeat_extra"))


@query("logs_read", f"WITH {_WRITTEN}")
def logs_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of logs that are found, filtered and read as files."""
    return _written(tokens.load(spark, log_folder(spark, sf_dir), since_days=1, logs="*.txt"))


@query("logs_of_a_project", f"WITH {_WRITTEN} WHERE project LIKE '%25_' AND right(project, 1) = '1'")
def logs_of_a_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of one project; the other one's aren't read."""
    return _written(tokens.load(spark, log_folder(spark, sf_dir), project="/home/my app%251", limit=5, logs="*.txt"))


_SUFFIXES = (".py", ".ts", ".md", ".lock", ".log", ".min.js", ".json", ".test.ts")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that import their neighbour's, every eighth of them of one kind; each source is a folder."""
    names = F.array(*[F.lit(s) for s in _SUFFIXES])
    suffix = F.element_at(names, (F.col("doc_id") % len(_SUFFIXES) + 1).cast("int"))
    head = F.when(F.col("doc_id") % 5 == 0, "// @generated\n").otherwise("")
    text = F.concat(head, F.lit("import '../"), F.col("source"), F.lit("/f"), F.col("doc_id") + 2, F.lit("'\n"), F.translate("text", "/", ""))
    rows = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    return rows.select(F.concat(F.col("source"), F.lit("/f"), F.col("doc_id"), suffix).alias("path"), F.col("n_chars").alias("size"), text.alias("content"), F.sha1(F.encode("text", "utf-8")).alias("digest"), (F.col("doc_id") % 11 == 0).alias("is_changed"), "doc_id", "source")


_MINIFIED = """m AS (SELECT doc_id, list_max(list_transform(l, lambda x: length(x))) > 2000 OR list_sum(list_transform(l, lambda x: length(x)))::DOUBLE / greatest(1, len(l)) > 350 AS minified FROM (
  SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split(substring(c, 1, 4000), chr(10)) AS l FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '// @generated' || chr(10) ELSE '' END || 'import ''../' || source || '/f' || (doc_id + 2) || '''' || chr(10) || replace(text, '/', '') AS c FROM documents WHERE text IS NOT NULL AND source IS NOT NULL))))"""
_CLASSES = f"""{_MINIFIED}, k AS (SELECT d.doc_id, d.source, CASE d.doc_id % 8 WHEN 4 THEN 0 WHEN 3 THEN 1 WHEN 5 THEN 1 ELSE CASE WHEN d.doc_id % 5 = 0 OR minified THEN 3 ELSE 5 END END AS class FROM documents d JOIN m USING (doc_id))"""


@query("file_classes", f"WITH {_CLASSES} SELECT source AS area, class, count(*) AS files FROM k GROUP BY ALL")
def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.classified(source_files(spark, sf_dir)).groupBy("area", "class").agg(F.count("*").alias("files"))


@query(
    "unreferenced_files",
    f"""WITH {_CLASSES} SELECT source, doc_id FROM k WHERE class = 5 AND doc_id % 8 IN (0, 1) AND doc_id % 11 <> 0
AND NOT EXISTS (SELECT 1 FROM k r WHERE r.class >= 3 AND r.source = k.source AND r.doc_id + 2 = k.doc_id)""",
)
def unreferenced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # three branches need it
    held = repo.features(source_files(spark, sf_dir)).select("path", "suffix", "stem", "class", "runs", "is_changed", "named").persist()
    found = repo.unreferenced(held, *repo.references(held))
    return found.select(F.substring_index("path", "/", 1).alias("source"), F.regexp_extract("path", r"/f(\d+)\.", 1).cast("bigint").alias("doc_id"))


@query(
    "js_surface",
    """WITH s AS (SELECT p_brand AS module, list(DISTINCT regexp_replace(p_type, '[^A-Za-z]+', '_', 'g')) AS names FROM part GROUP BY 1)
SELECT module, 'Types of ' || module AS summary, array_to_string(list_sort(list_transform(names, lambda n: '`' || n || '`')), ',') AS symbols FROM s""",
)
def js_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.collect_set(F.concat(F.lit("export default class "), F.regexp_replace("p_type", "[^A-Za-z]+", "_"), F.lit(" {}\n")))
    sources = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("module")).agg(names.alias("lines"))
    text = F.concat(F.lit("\n// Types of "), F.col("module"), F.lit(".\n"), F.array_join("lines", ""), F.lit("class Hidden {}\n"))
    found = sources.select("module", surface.expression_symbols(text, F.lit(".ts")).alias("s"))
    return found.select("module", "s.summary", F.array_join(F.array_sort("s.symbols"), ",").alias("symbols"))
