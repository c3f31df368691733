"""Readers and writers of the exchange formats: term bases, translation memories, bibliographies, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.text import memory_eligible, strip


def read_termbase(spark: SparkSession, path: str) -> DataFrame:
    """CSV with Source and Target and, if there, Behavior, Status, Preferred, Scope, Note and Forbidden (split at semicolons and commas)."""
    raw = spark.read.csv(path, header=True)
    for needed in ("Source", "Target"):
        if needed not in raw.columns:
            raise ValueError(f"a term base needs a column {needed}")
    get = lambda c, default="": F.coalesce(F.col(c), F.lit(default)) if c in raw.columns else F.lit(default)
    forbidden = F.filter(F.transform(F.split(get("Forbidden"), "[;；,，]"), lambda x: strip(x)), lambda x: x != "")
    return raw.filter("trim(Source) <> '' AND trim(Target) <> ''").select(
        strip(F.col("Source")).alias("source"), strip(F.col("Target")).alias("target"), get("Preferred").alias("preferred"), forbidden.alias("forbidden"),
        get("Behavior", "translate").alias("behavior"), get("Status", "provisional").alias("status"), get("Scope").alias("scope"), get("Note").alias("note"),
    )


def read_tmx(spark: SparkSession, path: str) -> DataFrame:
    """First and last segment of each unit of a translation memory, where they can be remembered."""
    raw = spark.read.format("xml").option("rowTag", "tu").schema("tuv array<struct<seg:string>>").load(path)
    both = raw.filter(F.size("tuv") >= 2).select(F.col("tuv")[0]["seg"].alias("source"), F.element_at("tuv", -1)["seg"].alias("target"))
    return both.filter(memory_eligible(F.col("source"), F.col("target")))


def write_tmx(memory: DataFrame, path: str) -> None:
    tuv = F.array(*[F.struct(F.lit(lang).alias("_lang"), F.col(c).alias("seg")) for lang, c in (("src", "source"), ("tgt", "target"))])
    memory.select(tuv.alias("tuv")).write.format("xml").option("rootTag", "body").option("rowTag", "tu").mode("overwrite").save(path)


def read_tbx(spark: SparkSession, path: str) -> DataFrame:
    """The first terms of the first two different languages of each entry, as locked terms; entries in one language only go."""
    lang = "struct<_lang:string,`_xml:lang`:string,tig:array<struct<term:string>>,ntig:array<struct<termGrp:struct<term:string>>>>"
    raw = spark.read.format("xml").option("rowTag", "termEntry").schema(f"langSet array<{lang}>").load(path)
    named = F.transform("langSet", lambda x, i: F.struct(F.coalesce(x["_lang"], x["_xml:lang"], F.concat(F.lit("#"), i)).alias("lang"), strip(F.coalesce(x["tig"][0]["term"], x["ntig"][0]["termGrp"]["term"])).alias("term")))
    sets = raw.select(F.filter(named, lambda x: F.coalesce(x["term"], F.lit("")) != "").alias("sets"))
    second = F.filter("sets", lambda x: x["lang"] != F.col("sets")[0]["lang"])
    return sets.filter("size(sets) > 0").withColumn("second", second).filter("size(second) > 0").select(F.col("sets")[0]["term"].alias("source"), F.col("second")[0]["term"].alias("target"), F.lit("locked").alias("status"))


def write_tbx(terms: DataFrame, path: str) -> None:
    lang = lambda name, c: F.struct(F.lit(name).alias("_lang"), F.array(F.struct(F.col(c).alias("term"))).alias("tig"))
    terms.select(F.array(lang("src", "source"), lang("tgt", "target")).alias("langSet")).write.format("xml").option("rootTag", "body").option("rowTag", "termEntry").mode("overwrite").save(path)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Entries of BibTeX files: key, title, author and year."""
    entry = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)@\w+\s*\{.*?\n\s*\}"), F.lit(0))).alias("e"))
    field = lambda name: F.regexp_extract("e", rf"(?is)\b{name}\s*=\s*[{{\"](.*?)[}}\"]\s*,?\s*\n", 1).alias(name)
    return entry.select(F.regexp_extract("e", r"@\w+\s*\{\s*([^,\s]+)", 1).alias("key"), field("title"), field("author"), field("year"))


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """Records of RIS files: key, title, authors, year, doi, url and journal. Lines without a tag continue the one before them."""
    record = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^\s*ER\s*[- ].*$")).alias("r")).filter(r"r rlike '(?m)^\s*TY\s*[- ]'")
    joined = record.select(F.regexp_replace("r", r"\r?\n(?!\s*[A-Z0-9]{2}\s*[- ])\s*(?=\S)", " ").alias("r"))
    last = lambda names: strip(F.coalesce(F.element_at(F.nullif(F.regexp_extract_all("r", F.lit(rf"(?m)^\s*(?:{names})\s*[- ]\s?(.*)$"), F.lit(1)), F.array().cast("array<string>")), -1), F.lit("")))
    authors = F.filter(F.transform(F.regexp_extract_all("r", F.lit(r"(?m)^\s*(?:AU|A1)\s*[- ]\s?(.*)$"), F.lit(1)), lambda x: strip(x)), lambda x: x != "")
    rows = joined.select(last("ID").alias("key"), last("TI|T1").alias("title"), authors.alias("authors"), F.regexp_extract(last("PY|Y1"), r"(\d{4})", 1).alias("year"), last("DO").alias("doi"), last("UR").alias("url"), last("JO|T2").alias("journal"))
    return rows.filter("title <> '' OR size(authors) > 0")


def read_states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Job states, an object a file or a line; those that are no object of the schema are left out."""
    raw = spark.read.schema(f"{schema}, __corrupt string").option("columnNameOfCorruptRecord", "__corrupt").json(path)
    return raw.withColumn("__ok", F.col("__corrupt").isNull()).filter("__ok").drop("__ok", "__corrupt")


def write_artifact(rows: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """JSON lines beside a folder with one line of metadata, as readers of artifacts expect."""
    rows.write.mode("overwrite").json(f"{path}/items")
    rows.sparkSession.createDataFrame([{"record_type": "artifact_metadata", **metadata}]).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/items")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of translation memories, each an object from sources to {target, reviewed, ...}: what is reviewed and fit to be kept. A file that is no such object, and entries that aren't, give nothing."""
    each = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("source", "entry"))
    said = F.coalesce(F.get_json_object("entry", "$.reviewed"), F.lit(""))
    own = each.filter(F.col("entry").startswith("{")).select("source", F.get_json_object("entry", "$.target").alias("target"), (~said.isin("", "false", "0", "null", "[]", "{}")).alias("reviewed"))
    return own.filter(F.col("reviewed") & memory_eligible(F.col("source"), F.coalesce("target", F.lit("")))).select("source", "target")


def read_glossary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of glossaries, each file a list of them or an object with such a list, in their order (pos)."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    whole = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.entries"))
    return text.select(F.posexplode(F.from_json(whole, f"array<struct<{schema}>>")).alias("pos", "e")).filter("e IS NOT NULL").select("pos", "e.*")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The sources of a corpus, a JSON object a line."""
    return spark.read.schema("source string").json(path).filter("source IS NOT NULL")


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(arm, job, and the fields of ``schema``) of the runs below a folder, ``runs/<arm>/run_meta.json`` naming the job whose ``runs/<arm>/<job>/state.json`` counts; arms without either have no row."""
    read = lambda tail: spark.read.text(f"{path}/runs/{tail}", wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    part = lambda p: F.regexp_extract("file", p, 1)
    metas = read("*/run_meta.json").select(part("/runs/([^/]+)/run_meta").alias("arm"), F.get_json_object("value", "$.job_id").alias("job"))
    states = read("*/*/state.json").select(part("/runs/([^/]+)/").alias("arm"), part("/runs/[^/]+/([^/]+)/state").alias("job"), F.from_json("value", schema).alias("state"))
    return metas.join(states, ["arm", "job"]).select("arm", "job", "state.*")


def write_csv(rows: DataFrame, path: str, *, columns: list[str] | None = None) -> None:
    """Rows as CSV with a header, the named columns in their order; a column that the rows lack is empty."""
    own = rows.columns
    rows.select(*(F.col(c) if c in own else F.lit(None).cast("string").alias(c) for c in columns or own)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


#: What a reviewer fills in.
MARKS = [f"candidate_{side}_{kind}" for side in "ab" for kind in ("terminology_error", "fidelity_error", "fluency_error", "omission")] + ["overall_preference", "reviewer_note"]


def write_packet(packet: DataFrame, path: str, *keys: str) -> None:
    """A packet of ``sampling.blind_packet`` as two CSVs apart: what reviewers see, with empty columns for their marks, and the key that tells the arms."""
    shown = packet.withColumn("identical", F.col("identical").cast("int"))
    write_csv(shown.orderBy("packet_id"), f"{path}/packet", columns=["packet_id", "category", *keys, "source", "candidate_a", "candidate_b", *MARKS, "identical"])
    other = F.when(F.col("left") == "A", "B").otherwise("A")
    key = packet.select("packet_id", *keys, "category", F.col("left").alias("candidate_a_is_arm"), other.alias("candidate_b_is_arm"))
    write_csv(key.orderBy("packet_id"), f"{path}/key")
