"""Reports derived from documents: sections are a document's segments with markers, beside a plan of what each should hold.

The expressions are SQL that Spark and DuckDB read alike, so queries and their SQL share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_N = "(doc_id + seg_idx)"
_CASE = "'seg-j-' || lpad(CAST({} % 7 AS STRING), 4, '0')"
BODY = f"""text || ' <!--claim:c' || (seg_idx % 5) || '-->'
|| CASE WHEN {_N} % 3 = 0 THEN ' <!--rq:q' || (doc_id % 4) || '-->' ELSE '' END
|| CASE WHEN {_N} % 4 = 0 THEN ' (' || {_CASE.format('seg_idx')} || ')' ELSE '' END
|| CASE WHEN seg_idx % 3 = 1 THEN ' [@src' || (doc_id % 23) || ']' ELSE '' END
|| CASE WHEN {_N} % 5 = 0 THEN ' <!--lit-claim:lc' || (seg_idx % 6) || '-->' ELSE '' END
|| CASE WHEN {_N} % 5 < 2 THEN ' <!--lit-evidence:LE-' || (seg_idx % 6) || '-->' ELSE '' END
|| CASE WHEN seg_idx % 6 = 2 THEN ' <!--term:t' || (doc_id % 12) || '-->' ELSE '' END
|| CASE WHEN seg_idx % 7 = 3 THEN ' <!--human-ev:h' || (doc_id % 8) || '-->' ELSE '' END
|| CASE WHEN seg_idx % 9 = 4 THEN ' SC-' || lpad(CAST(doc_id % 5 AS STRING), 4, '0') ELSE '' END
|| CASE WHEN {_N} % 29 = 0 THEN ' {{{{STAT:total}}}}' ELSE '' END
|| CASE WHEN {_N} % 31 = 0 THEN ' {{{{TERM:t1}}}}' ELSE '' END
|| CASE WHEN {_N} % 11 = 0 THEN ' Smith (2009) says so' ELSE '' END"""

#: kind, what it plans, where.
PLAN = [
    ("claim", "'c' || (seg_idx % 4)", "true"), ("case", _CASE.format("seg_idx"), "true"), ("case", _CASE.format("(seg_idx + 1)"), "true"), ("rq", "'q' || (doc_id % 4)", "seg_idx % 2 = 0"),
    ("lit_claim", "'lc' || (seg_idx % 6)", "seg_idx % 5 < 3"), ("lit_evidence", "'LE-' || (seg_idx % 6)", "seg_idx % 5 < 2"), ("source", "'src' || (doc_id % 23)", "seg_idx % 4 = 1"),
]
#: What is registered of each kind.
KNOWN = [(kind, f"{stem}{k}") for kind, stem, n in (("claim", "c", 3), ("rq", "q", 3), ("lit_claim", "lc", 5), ("lit_evidence", "LE-", 5), ("term", "t", 10)) for k in range(n)] + [("case", f"seg-j-{k:04d}") for k in range(6)]
#: source_id, year, first author, citable; source of each piece of literature evidence; human evidence with its status and conflict.
SOURCES = [(f"src{k}", 2000 + k, "Anna Smith" if k % 2 == 0 else "Bo Jones", k % 7 != 3) for k in range(20)]
EVIDENCE_SOURCES = [(f"LE-{k}", f"src{k}") for k in range(5)]
HUMAN = [(f"h{k}", "user_confirmed" if k % 3 else "superseded", "contradicted" if k == 4 else "none") for k in range(6)]
CLAIM_HUMAN = [("c0", "h1"), ("c0", "h9"), ("c1", "h3"), ("c2", "h2")]


def values(rows: list[tuple], names: str) -> str:
    """The rows as a SQL table."""
    return f"(SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) AS v({names}))"


SECTION_SQL = f"sec AS (SELECT doc_id, seg_idx, {BODY} AS body FROM seg)"
PLAN_SQL = "plan AS (" + " UNION ALL ".join(f"SELECT doc_id, seg_idx, '{kind}' AS kind, {x} AS ref FROM seg WHERE {where}" for kind, x, where in PLAN) + ")"
KNOWN_SQL = f"known AS {values(KNOWN, 'kind, ref')}"


def sections(segments: DataFrame) -> DataFrame:
    return segments.selectExpr("doc_id", "seg_idx", f"{BODY} AS body")


def plan(segments: DataFrame) -> DataFrame:
    each = ", ".join(f"CASE WHEN {where} THEN named_struct('kind', '{kind}', 'ref', {x}) END" for kind, x, where in PLAN)
    return segments.selectExpr("doc_id", "seg_idx", f"inline(filter(array({each}), x -> x IS NOT NULL))")


def registry(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
