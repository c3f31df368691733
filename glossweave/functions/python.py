"""Functions that no built-in expresses, as Arrow-batched pandas UDFs; each keeps a small row-wise helper."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types, not DDL strings: executors import this module, where no session parses one.
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_DELTA = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("op", "old", "new")]))
#: From so much on, the end of a text is taken for the next one. Fixed value.
ALIKE = 0.75
_ALIKE = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-"})


def normalised(x: str | None, *, punctuation: bool = True) -> str:
    """NFKC, case-folded, without white space; without punctuation too if asked."""
    kept = (c for c in unicodedata.normalize("NFKC", x or "").casefold() if not c.isspace() and (punctuation or unicodedata.category(c)[0] not in "PZ"))
    return "".join(kept)


def revised(x: str | None, y: str | None) -> bool:
    m, n = normalised(x), normalised(y)
    return bool(m and n and m != n) and normalised(x, punctuation=False) != normalised(y, punctuation=False)


@F.pandas_udf(T.BooleanType())
def meaningful_revision(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether both versions hold text and differ in more than white space, case, width or punctuation."""
    return pd.Series(list(map(revised, a, b)), dtype=bool)


@F.pandas_udf(T.StringType())
def bare(x: pd.Series) -> pd.Series:
    """A text as revisions are compared: NFKC, case-folded, without white space and punctuation."""
    return pd.Series([normalised(t, punctuation=False) for t in x])


@F.pandas_udf(T.DoubleType())
def tail_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike the end of a text is to the whole of the next, matched block by block; null if the next has under 60 characters or is longer. Where even the characters that both have
    make less than ``ALIKE``, that bound is given, and blocks aren't matched."""

    def one(x: str | None, y: str | None) -> float | None:
        m, n = normalised(x), normalised(y)
        if len(n) < 60 or len(m) < len(n):
            return None
        found = difflib.SequenceMatcher(None, m[-len(n) :], n, autojunk=False)
        bound = found.quick_ratio()
        return bound if bound < ALIKE else found.ratio()

    return pd.Series(list(map(one, a, b)), dtype="Float64")


def _find(needle: str, text: str) -> tuple[int, int] | None:
    if not needle or not needle.strip():
        return None
    at = text.find(needle)
    if at < 0:
        # character for character alike, runs of white space as one, an ellipsis in one character or three
        pattern = r"\s+".join(re.escape(x.replace("…", "...")).replace(r"\.\.\.", r"(?:\.\.\.|…)") for x in needle.translate(_ALIKE).split())
        found = re.search(pattern, text.translate(_ALIKE))
        return found.span() if found else None
    return at, at + len(needle)


@F.pandas_udf(_SPAN)
def find_span(needle: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Where the needle stands: as it is, or else whatever the shape of its quotes, dashes and white space."""
    got = [_find(n or "", t or "") or (None, None) for n, t in zip(needle, text, strict=True)]
    return pd.DataFrame({"start": pd.array([x for x, _ in got], dtype="Int32"), "end": pd.array([y for _, y in got], dtype="Int32")})


@F.pandas_udf(_DELTA)
def delta(old: pd.Series, new: pd.Series) -> pd.Series:
    """What was replaced, deleted or inserted between two versions, word by word."""

    def one(a: str | None, b: str | None) -> list[dict]:
        x, y = (a or "").split(), (b or "").split()
        codes = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        return [{"op": op, "old": " ".join(x[i:j]), "new": " ".join(y[k:m])} for op, i, j, k, m in codes if op != "equal"]

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


_CONTRAST = T.StructType([T.StructField("changed", T.BooleanType()), T.StructField("changes", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("operation", "baseline", "optimized")])))])


@F.pandas_udf(_CONTRAST)
def contrast(baseline: pd.Series, optimized: pd.Series) -> pd.DataFrame:
    """Whether two versions differ in more than form, and the edits between them, character by character, each side clipped at 120; none if they don't."""

    def one(a: str | None, b: str | None) -> tuple[bool, list[dict]]:
        x, y = a or "", b or ""
        if not revised(x, y):
            return False, []
        codes = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        return True, [{"operation": op, "baseline": x[i:j][:120], "optimized": y[k:m][:120]} for op, i, j, k, m in codes if op != "equal"]

    got = [one(a, b) for a, b in zip(baseline, optimized, strict=True)]
    return pd.DataFrame({"changed": [c for c, _ in got], "changes": [x for _, x in got]})


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def _tolerant(x: str | None):
    """The first JSON value in an answer, fenced or among other text; None if there is none."""
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", x or "")
    reader = json.JSONDecoder()
    for at in [0, *(m.start() for m in re.finditer(r"[\[{]", body))]:
        try:
            return reader.raw_decode(body[at:].lstrip())[0]
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def tolerant_json(x: pd.Series) -> pd.Series:
    return pd.Series([None if (v := _tolerant(t)) is None else json.dumps(v, ensure_ascii=False) for t in x])


def _answers(text: str | None, n: int) -> list[str] | None:
    value = _tolerant(text)
    if isinstance(value, dict):
        value = [value.get(str(k + 1)) for k in range(n)]
    if isinstance(value, list):
        value = [next((x[k] for k in ("translation", "target", "text") if k in x), None) if isinstance(x, dict) else x for x in value]
    else:
        lines = re.findall(r"(?m)^\s*\d+[.)、:]\s*(.+)$", text or "")
        value = lines if len(lines) == n else [text.strip()] if n == 1 and (text or "").strip() else None
    ok = value is not None and len(value) == n and all(isinstance(x, str) for x in value)
    return value if ok else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def answers(text: pd.Series, n: pd.Series) -> pd.Series:
    """A batch's ``n`` answers: a list, an object by number, numbered lines, or the text itself for one; null unless all are there."""
    return pd.Series([_answers(t, int(k)) for t, k in zip(text, n, strict=True)])


def model_call(call: Callable[[str], str]) -> Callable[[Column], Column]:
    """The boundary to a language model: an injected function from prompt to answer, null where it fails three times."""

    @F.pandas_udf(T.StringType())
    def ask(prompts: pd.Series) -> pd.Series:
        def one(prompt: str) -> str | None:
            for _ in range(3):
                try:
                    return call(prompt)
                except Exception:  # noqa: BLE001, S112  the model's own failure
                    continue
            return None

        return prompts.map(one)

    return ask


def echo_model(prompt: str) -> str:
    """The stub that stands in for a model: each numbered line of the prompt comes back in brackets, as a JSON list."""
    return json.dumps([f"[{x}]" for x in re.findall(r"(?m)^\d+\. (.*)$", prompt)], ensure_ascii=False)
