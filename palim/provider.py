"""Model calls behind one protocol, with a deterministic offline stand-in, retries and schema rules."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palim.operators.segmentation import STUB_LOW_INFO_CHARS, STUB_SPLIT_EVERY
from palim.schemas import CLASSIFY_MAX, EMBEDDING_DIM, SPLIT_ABOVE
from palim.shipping import ship
from palim.streaming.segments import starts_to_ranges

ATTEMPTS = 4
#: Memories that one review call rates.
REVIEW_BATCH = 50
DELAYS = (0.5, 1.0, 2.0)
#: Too many requests.
BUSY = 429


class ModelError(Exception):
    """A failed model call; status and code as the service gave them."""

    def __init__(self, message: str, status: int | None = None, code: str | None = None):
        super().__init__(message)
        self.status, self.code = status, code


def is_transient(error: Exception) -> bool:
    """Failures of the line, of a busy service, and of the service itself may pass; what the service rejects won't."""
    status = getattr(error, "status", None)
    return isinstance(error, (TimeoutError, ConnectionError)) or (status is not None and (status == BUSY or status // 100 == 5))


def with_retry(call: Callable[[], Any], attempts: int = ATTEMPTS, delays: tuple = DELAYS, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's value; retryable failures are tried again after growing delays."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if i == attempts - 1 or not is_transient(e):
                raise
            sleep(delays[min(i, len(delays) - 1)])
    raise AssertionError


def backoff_ms(attempt: int) -> int:
    """Of a client's request, from attempt 1."""
    return min(1500 * 2 ** (attempt - 1), 10_000)


class ModelProvider(Protocol):
    def embed_many(self, texts: list[str]) -> list[list[float]]: ...

    def generate_text(self, messages: list[dict]) -> str: ...

    def generate_object(self, name: str, payload: dict, schema: dict) -> dict: ...


def bounded_embedding(vector: list[float], dim: int = EMBEDDING_DIM) -> list[float]:
    """Longer vectors are cut and scaled, those of dim scaled unless of length 1, shorter ones an error."""
    if len(vector) < dim:
        raise ValueError(f"embedding has {len(vector)} of {dim} dimensions")
    cut = vector[:dim]
    square = sum(x * x for x in cut)
    if len(vector) == dim and abs(square - 1) <= 1e-6 or math.sqrt(square) <= 1e-12:
        return cut
    return [x / math.sqrt(square) for x in cut]


class OfflineProvider:
    """Stand-ins for every call, fixed by their input."""

    def __init__(self, dim: int = EMBEDDING_DIM):
        self.dim = dim

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        """Words counted by hash, scaled to length 1, in the order of the texts."""
        out = []
        for text in texts:
            vector = [0.0] * self.dim
            for word in re.findall(r"[^\W_]+", text.lower()):
                vector[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim] += 1.0
            out.append(bounded_embedding(vector, self.dim))
        return out

    def embed(self, text: str) -> list[float]:
        return self.embed_many([text])[0]

    def generate_text(self, messages: list[dict]) -> str:
        return messages[-1]["content"].strip().split("\n")[0]

    def generate_object(self, name: str, payload: dict, schema: dict | None = None) -> dict:
        lines = payload.get("messages", [])
        if name == "primitive_segment_classification":
            return {"classification": "low_info" if sum(len(m["content"]) for m in lines) < STUB_LOW_INFO_CHARS else "informative"}
        if name in ("primitive_segment_split", "constrained_resegmentation"):
            return {"split_start_message_indices": list(range(STUB_SPLIT_EVERY, len(lines), STUB_SPLIT_EVERY))}
        if name == "episodic_title_generation":
            return {"title": " ".join(re.findall(r"[^\W_]+", " ".join(m["content"] for m in lines).lower())[:12])}
        if name == "episodic_time_anchoring":
            return {"insertions": []}
        if name in ("pcl_cold_start", "pcl_calibrate"):
            user = [m["content"] for m in lines if m["role"].lower() == "user"]
            return {"actions": [{"kind": "new", "fact": t[:200], "category": "experience", "target_fact_id": "", "justification": "", "confidence": 0.8} for t in user[:1]]}
        if name == "memory_review":
            return {"ratings": [{"memory_id": i, "rating": "good"} for i in payload.get("memory_ids", [])]}
        if name == "qa_answer":
            return {"answer": payload.get("context", "").split("\n")[0]}
        if name == "judge":
            return {"label": "CORRECT" if payload["gold"].strip().lower() in payload["prediction"].lower() else "WRONG"}
        raise ModelError(f"no stand-in for {name}")


def checked_embeddings(provider: ModelProvider, texts: list[str]) -> list[list[float]]:
    """Embeddings of all texts, in order; another count than asked for is an error."""
    if not texts:
        return []
    out = with_retry(lambda: provider.embed_many(texts))
    if len(out) != len(texts):
        raise ModelError(f"{len(out)} embeddings for {len(texts)} texts")
    return out


def embed_column(rows: DataFrame, column: str, provider: ModelProvider, name: str = "embedding") -> DataFrame:
    """Adds the embedding of a text column: a call for each Arrow batch, on the executors."""

    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            vectors = checked_embeddings(provider, [t or "" for t in b.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*b.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))


_INSERTION = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("exact", T.StringType()), T.StructField("anchor", T.StringType())])


def insertions_column(rows: DataFrame, messages: str, provider: ModelProvider, name: str = "insertions") -> DataFrame:
    """Adds the time anchors that a model proposes for an array of (role, content, ts): (line, exact text, anchor). A failed call proposes none."""
    ship(rows.sparkSession)

    def proposed(lines: list) -> list:
        payload = {"messages": [{"line_index": i, "spoken_at": str(m["ts"]), "role": m["role"], "content": m["content"]} for i, m in enumerate(lines)]}
        try:
            found = with_retry(lambda: provider.generate_object("episodic_time_anchoring", payload, {}))
            return [{"line": int(x["line_index"]), "exact": x["exact_text"], "anchor": x["anchor_text"]} for x in found["insertions"]]
        except Exception:
            return []

    def run(batches):
        for b in batches:
            out = pa.array([proposed(m or []) for m in b.column(messages).to_pylist()], pa.list_(pa.struct([("line", pa.int32()), ("exact", pa.string()), ("anchor", pa.string())])))
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(_INSERTION))]))


def _call(provider: ModelProvider, name: str, messages: list, **more) -> dict:
    payload = {"messages": [{"role": m["role"], "content": m["content"], "timestamp": str(m["ts"])} for m in messages], **more}
    return with_retry(lambda: provider.generate_object(name, payload, {}))


def _ranges(answer: dict, n: int) -> list[tuple[int, int]]:
    """Ranges from the proposed starts; what isn't a list of integers is an error."""
    starts = answer["split_start_message_indices"]
    if not isinstance(starts, list) or any(isinstance(i, bool) or not isinstance(i, int) for i in starts):
        raise ModelError("split starts must be integers")
    return starts_to_ranges(n, starts)


def _checked(row: dict) -> list:
    """The messages of a segment: they must begin and end where it does."""
    messages = row["messages"] or []
    if not messages or messages[0]["seq"] != row["start_seq"] or messages[-1]["seq"] != row["end_seq"]:
        raise ModelError("messages don't match the segment's range")
    return messages


def _classified(provider: ModelProvider, messages: list) -> str:
    if len(messages) > CLASSIFY_MAX:
        return "informative"
    kind = _call(provider, "primitive_segment_classification", messages)["classification"]
    if kind not in ("low_info", "informative"):
        raise ModelError(f"unknown classification {kind}")
    return kind


_SEGMENT = "conversation_id string, start_seq long, end_seq long, n long, classification string, origin string, gap_minutes long"


def _by_row(rows: DataFrame, made: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """made(row) for each row, on the executors."""
    ship(rows.sparkSession)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches):
        for b in batches:
            out = [x for row in b.to_pylist() for x in made(row)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], arrow) if out else pa.RecordBatch.from_pylist([], arrow)

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return rows.mapInArrow(run, schema)


def reviewed(buckets: DataFrame, provider: ModelProvider) -> DataFrame:
    """buckets: conversation_id, start_seq, end_seq, origin, gap_minutes, messages (seq, role, content, ts). Their segments: small ones
    classified by the model, large ones split by it; a split that can't be read leaves one informative segment."""

    def made(row: dict) -> list[tuple]:
        messages = _checked(row)
        n = len(messages)
        parts, kinds = [(0, n - 1)], None
        if n > SPLIT_ABOVE:
            try:
                parts = _ranges(_call(provider, "primitive_segment_split", messages), n)
            except (ModelError, KeyError, TypeError) as e:
                if is_transient(e):
                    raise
                kinds = ["informative"]
        kinds = kinds or [_classified(provider, messages[a : z + 1]) for a, z in parts]
        return [
            (row["conversation_id"], messages[a]["seq"], messages[z]["seq"], z - a + 1, kind, "llm_locked" if i else row["origin"], None if i else row["gap_minutes"])
            for i, ((a, z), kind) in enumerate(zip(parts, kinds))
        ]

    return _by_row(buckets, made, _SEGMENT)


def resegmented(groups: DataFrame, provider: ModelProvider) -> DataFrame:
    """groups: conversation_id, start_seq, end_seq, messages. Informative segments by the model's starts; an answer that can't be read is an error."""

    def made(row: dict) -> list[tuple]:
        messages = _checked(row)
        return [(row["conversation_id"], messages[a]["seq"], messages[z]["seq"], "informative") for a, z in _ranges(_call(provider, "constrained_resegmentation", messages), len(messages))]

    return _by_row(groups, made, "conversation_id string, start_seq long, end_seq long, classification string")


def titles(episodes: DataFrame, provider: ModelProvider) -> DataFrame:
    """id and title of each episode (id, messages)."""
    return _by_row(episodes.select("id", "messages"), lambda row: [(row["id"], str(_call(provider, "episodic_title_generation", row["messages"]).get("title") or ""))], "id string, title string")


def proposed_actions(calls: DataFrame, provider: ModelProvider) -> DataFrame:
    """calls: id, title, messages (role, content, ts), related and chosen (arrays of category and fact, related with id). Without related facts, facts are
    drawn from the episode; else from what a prediction by the chosen ones misses."""

    def made(row: dict) -> list[tuple]:
        line = lambda f: f"- [{f['category']}] {f['fact']}"
        if not row["related"]:
            answer = _call(provider, "pcl_cold_start", row["messages"], title=row["title"])
        else:
            known = "\n".join(line(f) for f in row["chosen"] or [])
            prediction = with_retry(lambda: provider.generate_text([{"role": "user", "content": f"Episode Title: {row['title']}\n\nExisting Knowledge:\n{known}"}]))
            answer = _call(provider, "pcl_calibrate", row["messages"], title=row["title"], facts=[line(f) for f in row["related"]], fact_ids=[f["id"] for f in row["related"]], prediction=prediction)
        return [(row["id"], i, a["kind"], a["fact"], a["category"], a["target_fact_id"], float(a["confidence"])) for i, a in enumerate(answer["actions"])]

    return _by_row(calls, made, "episode_id string, place long, kind string, fact string, category string, target_fact_id string, confidence double")


def rated(ids: DataFrame, provider: ModelProvider) -> DataFrame:
    """memory_id, place, rating as the model gives them, REVIEW_BATCH memories to a call."""
    ship(ids.sparkSession)
    schema = "memory_id string, place long, rating string"

    def run(batches):
        for b in batches:
            all_ids = b.column("memory_id").to_pylist()
            for i in range(0, len(all_ids), REVIEW_BATCH):
                part = all_ids[i : i + REVIEW_BATCH]
                found = with_retry(lambda: provider.generate_object("memory_review", {"memory_ids": part}, {}))["ratings"]
                yield pa.RecordBatch.from_arrays([pa.array([r["memory_id"] for r in found], pa.string()), pa.array(range(len(found)), pa.int64()), pa.array([r["rating"] for r in found], pa.string())], ["memory_id", "place", "rating"])

    return ids.select("memory_id").mapInArrow(run, schema)


def typed(text: str, required: tuple[str, ...]) -> dict:
    """A model's JSON object; a missing key is an error."""
    value = json.loads(text)
    missing = [k for k in required if k not in value]
    if missing:
        raise ModelError(f"model output lacks {', '.join(missing)}")
    return value
