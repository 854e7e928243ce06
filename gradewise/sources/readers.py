"""File sources: suite manifest, case configs, response folders, batch
inference results.

YAML files are read whole (``wholetext``), parsed per file inside
``mapInPandas`` (one small codec call per file, distributed over tasks) and
turned into JSON so Spark holds the nested grading spec as VARIANT; every
field the jobs need is pulled out with ``try_variant_get``. A file that does
not parse becomes a row of the error table instead of failing the job.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradewise.functions.text import path_stem
from gradewise.session import ship_package

_PARSED = "path string, json string, error string"


def _parse_yaml(batches):
    import yaml
    for pdf in batches:
        out = []
        for path, text in zip(pdf["path"], pdf["value"]):
            try:
                out.append((path, json.dumps(yaml.safe_load(text)), None))
            except Exception as e:  # noqa: BLE001 - bad file -> error row
                out.append((path, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=["path", "json", "error"])


def read_yaml(spark: SparkSession, paths) -> DataFrame:
    """path, doc VARIANT, error (null when parsed)."""
    ship_package(spark)
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = raw.mapInPandas(_parse_yaml, _PARSED)
    return parsed.select("path", F.try_parse_json("json").alias("doc"), "error")


def _v(doc, path, typ):
    return F.try_variant_get(doc, path, typ)


def read_suite(spark: SparkSession, path: str):
    """(suite one-row DataFrame, suite_cases DataFrame).

    Entries of ``cases`` are a path string or ``{path, weight}``; the order
    of the list is kept as ``case_no``."""
    y = read_yaml(spark, path)
    suite = y.select(
        F.coalesce(_v("doc", "$.attempt_reduce_mode", "string"), F.lit("avg")).alias("attempt_reduce_mode"),
        F.coalesce(_v("doc", "$.full_score_per_question", "double"), F.lit(1.0)).alias("full_score_per_question"),
        F.coalesce(_v("doc", "$.null_score_per_question", "double"), F.lit(0.0)).alias("null_score_per_question"),
        _v("doc", "$.version", "string").alias("version"))
    entries = y.select(F.posexplode(F.try_variant_get("doc", "$.cases", "array<variant>")).alias("case_no", "e"))
    cases = entries.select(
        F.col("case_no").cast("int").alias("case_no"),
        F.coalesce(_v("e", "$.path", "string"), _v("e", "$", "string")).alias("case_path"),
        F.coalesce(_v("e", "$.weight", "double"), F.lit(1.0)).alias("case_weight"))
    return suite, cases


GRADING_KINDS = ("keywords", "blank_filling", "unit_test", "similarity", "customized")


def read_cases(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(cases, errors). cases: case_path, case_id, prompt_path, lang, qtype,
    full_score, null_score, max_score, min_score, grading_keys, grading."""
    y = read_yaml(spark, paths)
    ok = y.where(F.col("error").isNull() & F.col("doc").isNotNull())
    keys = F.filter(F.array(*[F.when(_v("doc", f"$.grading.{k}", "variant").isNotNull(), F.lit(k))
                              for k in GRADING_KINDS]), lambda x: x.isNotNull())
    cases = ok.select(
        F.col("path").alias("case_path"),
        F.coalesce(_v("doc", "$.id", "string"), path_stem(F.col("path"))).alias("case_id"),
        _v("doc", "$.prompt_path", "string").alias("prompt_path"),
        _v("doc", "$.lang", "string").alias("lang"),
        _v("doc", "$.type", "string").alias("qtype"),
        _v("doc", "$.full_score", "double").alias("full_score"),
        _v("doc", "$.null_score", "double").alias("null_score"),
        _v("doc", "$.grading.max_score", "double").alias("max_score"),
        _v("doc", "$.grading.min_score", "double").alias("min_score"),
        keys.alias("grading_keys"),
        _v("doc", "$.grading", "variant").alias("grading"))
    errors = y.where(F.col("error").isNotNull() | F.col("doc").isNull()).select(
        F.col("path").alias("case_path"), F.lit("load").alias("stage"),
        F.coalesce("error", F.lit("empty document")).alias("reason"))
    return cases, errors


def warnings(cases: DataFrame) -> DataFrame:
    """Data-quality warnings: missing lang/type, unexpected type."""
    known = ["code debugging", "code completion", "knowledge question-answering", "non-code debugging"]
    w = (F.when(F.col("lang").isNull(), F.lit("language not specified"))
          .when(F.col("qtype").isNull(), F.lit("question type not specified"))
          .when(~F.col("qtype").isin(*known), F.concat(F.lit("unusual question type: "), F.col("qtype"))))
    return cases.select("case_id", w.alias("warning")).where(F.col("warning").isNotNull())


def score_warnings(samples: DataFrame) -> DataFrame:
    """A warning for every sample whose score, after its bounds, is negative
    (samples: model, case_id, sample_no, ans as from ``reduce.clip_normalise``)."""
    text = F.concat(F.lit("negative score: "), F.round("ans", 6).cast("string"))
    return samples.where(F.col("ans") < 0).select("model", "case_id", "sample_no", text.alias("warning"))


def keyword_rules(cases: DataFrame) -> DataFrame:
    """Flat keyword rules of leaf-only rules (string, or content string):
    case_id, rule_no, pattern, weight, to_lower, neg, cond, is_regex, error. A rule
    with nested contents has no pattern here but an error (``keyword_nodes`` takes
    rules of any depth), and ``keyword_scores`` gives its case that error."""
    rules = cases.select("case_id", F.posexplode(
        F.try_variant_get("grading", "$.keywords", "array<variant>")).alias("rule_no", "r"))
    is_obj = F.startswith(F.schema_of_variant("r"), F.lit("OBJECT"))
    content = F.when(~is_obj, _v("r", "$", "string")).otherwise(F.coalesce(
        _v("r", "$.content.content", "string"),
        F.when(~F.startswith(F.schema_of_variant(_v("r", "$.content", "variant")), F.lit("OBJECT")),
               _v("r", "$.content", "string"))))
    return rules.where(_v("r", "$.post_handler", "variant").isNull()).select(
        "case_id", F.col("rule_no").cast("int").alias("rule_no"), content.alias("pattern"),
        F.coalesce(_v("r", "$.weight", "double"), F.lit(1.0)).alias("weight"),
        F.coalesce(_v("r", "$.to_lower", "boolean"), F.lit(False)).alias("to_lower"),
        F.coalesce(_v("r", "$.neg", "boolean"), F.lit(False)).alias("neg"),
        _v("r", "$.content.cond", "string").alias("cond"),
        F.coalesce(_v("r", "$.content.regex", "boolean"), F.lit(False)).alias("is_regex"),
        F.when(content.isNull(), F.lit("nested rule")).alias("error"))


def read_responses(spark: SparkSession, responses_dir: str, manifest: DataFrame, model: str) -> DataFrame:
    """Response files joined to the manifest (case_path -> ordered file list).

    manifest: case_path, files array<string>. Output: model, case_path,
    sample_no, text, error. A file that is listed but absent is a row without text
    and with an error."""
    files = spark.read.text(f"{responses_dir.rstrip('/')}/*.txt", wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    m = manifest.select("case_path", F.posexplode("files").alias("sample_no", "file"))
    lost = F.when(F.col("text").isNull(), F.concat(F.lit("response file not found: "), "file"))
    return m.join(files, "file", "left").select(F.lit(model).alias("model"), "case_path",
                                                F.col("sample_no").cast("int").alias("sample_no"), "text", lost.alias("error"))


def read_manifest(spark: SparkSession, params_path: str) -> DataFrame:
    """``answer_paths`` map of a run's params file -> case_path, files."""
    y = read_yaml(spark, params_path)
    m = F.try_variant_get("doc", "$.answer_paths", "map<string, array<string>>")
    return y.select(F.explode(m).alias("case_path", "files"))


CSV_SCHEMA = "filename string, completion string"


def arrival() -> Column:
    """The place of a row of a file source: struct(file, block, row). The path of
    its file, the start of its block in there, and a number that grows with the rows of
    a block. Ordering by it is arrival order over any number of files, however they
    are dealt to tasks."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def read_batch_csv(spark: SparkSession, path) -> DataFrame:
    """Batch-inference CSV (filename, completion), one file or several; ``place``
    (see ``arrival``) keeps the order of files and rows for the sample index, and
    ``input_pos`` that of the rows of a file; a null completion becomes ''."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .schema(CSV_SCHEMA).csv(path))
    return df.select("filename", F.coalesce("completion", F.lit("")).alias("completion"),
                     F.col("completion").isNull().alias("was_null"),
                     F.monotonically_increasing_id().alias("input_pos"), arrival().alias("place"))


def read_batch_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Batch-inference parquet file or folder (``*.parquet`` only); parts are
    unioned by name."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(path)


def resolve_texts(rules: DataFrame, files: DataFrame, content: str = "content",
                  path: str = "path") -> DataFrame:
    """Inline text or ``path`` reference -> text (left join to a files table
    ``path, text`` read with ``wholetext``)."""
    f = files.select(F.col(path).alias("__p"), F.col("text").alias("__t"))
    j = rules.join(f, rules[path] == f["__p"], "left")
    return j.withColumn("text", F.coalesce(F.col(content), F.col("__t"))).drop("__p", "__t")


NODE_SCHEMA = ("case_id string, rule_no int, node_id int, parent_id int, op string, pattern string, "
               "is_regex boolean, cond string, weight double, to_lower boolean, neg boolean")


def _flatten_rules(batches):
    """Keyword rule lists -> post-ordered node rows (``specs.flatten``)."""
    from gradewise.sources.specs import keyword_rules as parse
    for pdf in batches:
        out = []
        for case_id, js in zip(pdf["case_id"], pdf["kw"]):
            rules, _ = parse([r for r in json.loads(js) if not (isinstance(r, dict) and "post_handler" in r)], [])
            out += [(case_id, r["rule_no"], n["node_id"], n["parent_id"], n["op"], n["pattern"], n["is_regex"], n["cond"],
                     r["weight"], r["to_lower"], r["neg"]) for r in rules for n in r["nodes"]]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def keyword_nodes(cases: DataFrame) -> DataFrame:
    """Keyword rules of any nesting depth as a node table (NODE_SCHEMA), without
    the post-handler, which ``sources.specs`` reads. Parsing a rule list is a per-case
    Python helper; evaluation is native (``operators.keywords.keyword_tree_scores``)."""
    ship_package(cases.sparkSession)
    kw = cases.select("case_id", F.to_json(F.try_variant_get("grading", "$.keywords", "variant")).alias("kw"))
    return kw.where(F.col("kw").isNotNull()).mapInPandas(_flatten_rules, NODE_SCHEMA)


def unpack_batch_csv(rows: DataFrame) -> DataFrame:
    """Batch CSV rows -> per-sample responses: the sample index of a case is
    its arrival order (``place``) among the rows of that case. Output: case_path,
    sample_no, text, was_null."""
    from gradewise.operators.indexing import arrival_index
    d = arrival_index(rows, ["filename"], "sample_no")
    return d.select(F.col("filename").alias("case_path"), F.col("sample_no").cast("int").alias("sample_no"),
                    F.col("completion").alias("text"), "was_null")


def null_completion_stats(rows: DataFrame) -> DataFrame:
    """Number of null completions and the set of cases they hit (the set is
    bounded by the number of cases)."""
    return rows.agg(F.count_if("was_null").alias("n_null"),
                    F.array_sort(F.collect_set(F.when(F.col("was_null"), F.col("filename")))).alias("cases"))
