"""Consolidation: model actions normalised, then applied in order to the facts of a conversation."""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from heapq import merge
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palim.functions.text import normalize_category
from palim.operators.components import components
from palim.operators.similarity_join import above, linked
from palim.schemas import ACTION_PRIORITY, DUPLICATE_SIMILARITY, PREDICT_FACTS, PREDICT_GUIDELINES, SIMILAR_FACTS
from palim.shipping import ship
from palim.sources.store import stored


def normalize_actions(actions: DataFrame) -> DataFrame:
    """actions: episode_id, place, kind, fact, category, target_fact_id, confidence. Gives them cleaned, in the order of application.

    Untargeted updates become new facts but still compete for the empty target, so that one of them survives.
    Of the actions on one target the strongest survives, of equals the first. New facts go first, then targets by place.
    """
    clean = actions.select(
        "episode_id", "place", "kind", F.trim("fact").alias("fact"), normalize_category(F.col("category")).alias("category"),
        F.trim("target_fact_id").alias("target_fact_id"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))).alias("confidence"),
    )
    clean = clean.withColumn("fact", F.when(F.col("kind") == "invalidate", "").otherwise(F.col("fact")))
    clean = clean.filter(~(F.col("kind").isin("new", "update") & (F.col("fact") == "")))
    clean = clean.filter(~(F.col("kind").isin("reinforce", "invalidate") & (F.col("target_fact_id") == "")))
    targeted = F.col("kind") != "new"
    clean = clean.withColumn("targeted", targeted)
    clean = clean.withColumn("kind", F.when((F.col("kind") == "update") & (F.col("target_fact_id") == ""), "new").otherwise(F.col("kind")))
    priority = F.lit(0)
    for name, value in ACTION_PRIORITY.items():
        priority = F.when(F.col("kind") == name, value).otherwise(priority)
    slot = F.when(F.col("targeted"), F.concat(F.lit("t:"), F.col("target_fact_id"))).otherwise(F.concat(F.lit("n:"), F.col("place").cast("string")))
    order = Window.partitionBy("episode_id", "slot").orderBy(F.desc("priority"), "place")
    kept = clean.withColumn("priority", priority).withColumn("slot", slot).withColumn("n", F.row_number().over(order)).filter("n = 1")
    return kept.drop("n", "slot", "priority")


def pick_for_prediction(facts: DataFrame) -> DataFrame:
    """facts: query_id, rank, id, category. Up to 3 guidelines first, then others up to 10 in all, each in rank order."""
    guideline = F.col("category") == "guideline"
    order = Window.partitionBy("query_id", "guideline").orderBy("rank")
    placed = facts.withColumn("guideline", guideline).withColumn("n", F.row_number().over(order))
    taken = F.least(F.lit(PREDICT_GUIDELINES), F.sum(F.col("guideline").cast("int")).over(Window.partitionBy("query_id")))
    placed = placed.withColumn("taken", taken)
    chosen = placed.filter((F.col("guideline") & (F.col("n") <= PREDICT_GUIDELINES)) | (~F.col("guideline") & (F.col("n") <= PREDICT_FACTS - F.col("taken"))))
    return chosen.withColumn("position", F.when(F.col("guideline"), F.col("n")).otherwise(F.col("n") + F.col("taken"))).drop("n", "taken")


def reinforce(facts: DataFrame, actions: DataFrame) -> DataFrame:
    """Facts with the episodes of their reinforce actions added to their sources, in order, none twice. Unknown targets are skipped."""
    added = actions.filter("kind = 'reinforce'").groupBy(F.col("target_fact_id").alias("id")).agg(F.array_sort(F.collect_set("episode_id")).alias("more"))
    both = facts.join(added, "id", "left")
    return both.withColumn("source_episodic_ids", F.when(F.col("more").isNull(), F.col("source_episodic_ids")).otherwise(F.array_union("source_episodic_ids", "more"))).drop("more")


def invalidate(facts: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    gone = actions.filter("kind = 'invalidate'").select(F.col("target_fact_id").alias("id")).distinct().withColumn("gone", F.lit(True))
    both = facts.join(gone, "id", "left")
    return both.withColumn("invalid_at", F.when(F.col("gone") & F.col("invalid_at").isNull(), now).otherwise(F.col("invalid_at"))).drop("gone")


def apply_in_order(facts: pd.DataFrame, actions: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The state of one conversation's facts after its actions, episode by episode.

    facts: id, category, fact, sources (list), valid (bool), embedding; actions, in order: episode_id, episode_pos, place, kind, fact, category,
    target_fact_id, embedding, scope (ids of the facts loaded for the episode). A new fact's id is its episode and place.
    """
    actions = actions.sort_values(["episode_pos", "place"], kind="stable")
    first = actions.drop_duplicates("episode_pos")
    own = {e: set(x) for e, x in zip(first["episode_pos"], first["scope"])}
    state, after = _State(threshold), {}
    state.named = set().union(*own.values())
    for i, category, fact, sources, valid, vector in facts[["id", "category", "fact", "sources", "valid", "embedding"]].itertuples(index=False, name=None):
        number = state.near.add(vector)
        after[i] = [category, fact, list(sources), bool(valid), number]
        if valid:
            state.add(i, number, sources)
    vectors = [state.near.add(v) if kind in ("new", "update") else -1 for kind, v in zip(actions["kind"], actions["embedding"])]
    names = ["episode_id", "episode_pos", "place", "kind", "fact", "category", "target_fact_id"]
    for (episode, at, place, kind, fact, category, target), vector in zip(actions[names].itertuples(index=False, name=None), vectors):
        if at != state.pos:
            state.open(at)
            state.loaded = own.get(at, set())
        state.act(episode, place, kind, fact, category, target, vector)
    state.close()
    for what, i, _, category, fact, source, _, active, _, vector in state.told:
        if what == "made":
            after[i] = [category, fact, [source], active, vector]
        elif what == "ended":
            after[i][3] = False
        elif source not in after[i][2]:
            after[i][2].append(source)
    rows = [(i, category, fact, len(sources), valid, sources, state.near.rows[vector]) for i, (category, fact, sources, valid, vector) in after.items()]
    return pd.DataFrame(rows, columns=["id", "category", "fact", "source_count", "active", "sources", "embedding"])


#: Near vectors that are remembered, over all vectors that actions have.
REMEMBERED = 2_000_000


class _Near:
    """The distinct vectors of a fold, and which of them are near a given one."""

    def __init__(self, threshold: float):
        self.threshold, self.number, self.rows, self.matrix, self.found, self.held = threshold, {}, [], None, {}, 0

    def add(self, vector) -> int:
        own = np.asarray([] if vector is None else vector, float)
        key = own.tobytes()
        if key not in self.number:
            self.number[key] = len(self.rows)
            self.rows.append(own)
        return self.number[key]

    def _ready(self) -> None:
        """All vectors are known."""
        self.sized, self.matrix, self.number = {}, {}, None
        for i, v in enumerate(self.rows):
            self.sized.setdefault(len(v), []).append(i)
        for d, at in self.sized.items():
            self.matrix[d] = np.array([self.rows[i] for i in at])
            for i, row in zip(at, self.matrix[d]):
                self.rows[i] = row

    def of(self, i: int) -> tuple[array, array]:
        """Vectors, the most similar first, and the ends of groups of equal similarity."""
        if self.matrix is None:
            self._ready()
        if i not in self.found:
            d = len(self.rows[i])
            score = self.matrix[d] @ self.rows[i] if d else np.zeros(len(self.sized[d]))
            hits = np.flatnonzero(score > self.threshold).tolist()
            far = [-round(s, 9) for s in score[hits].tolist()]
            order = sorted(range(len(hits)), key=far.__getitem__)
            ends = array("i", [n + 1 for n, k in enumerate(order) if n + 1 == len(order) or far[k] != far[order[n + 1]]])
            self.held += len(hits)
            if self.held > REMEMBERED:
                self.found, self.held = {}, len(hits)
            self.found[i] = array("i", [self.sized[d][hits[k]] for k in order]), ends
        return self.found[i]


class _State:
    """Facts that actions may still change, and those that stand in the way of others. What becomes of facts is told at once (`told`, see _TOLD) and not kept.

    An action looks at the distinct vectors near its own and at the first few valid facts of each, so that copies of a vector cost nothing.
    A fact that no later episode loads can't change after its own; of such facts with one vector only the SIMILAR_FACTS least ids are ever looked at, and the others go.
    """

    def __init__(self, threshold: float):
        self.near = _Near(threshold)
        self.empty = self.near.add(None)
        self.always, self.named, self.loaded = set(), set(), set()  # ids loaded for all episodes, for any, for this one
        self.valid: dict[str, list] = {}  # of each valid fact its vector, first sources, last source, and whether it is new
        self.usable: dict[int, list[str]] = {}  # of each vector the ids of its valid facts, sorted
        self.lasting: dict[int, list[str]] = {}  # of these, those that were made and can't change any more
        self.fresh: dict[str, list] = {}  # facts made in this episode
        self.pos, self.n, self.told = None, 0, []

    def add(self, i: str, vector: int, sources, made: bool = False) -> None:
        self.valid[i] = [vector, frozenset(sources), None, made]
        insort(self.usable.setdefault(vector, []), i)

    def open(self, pos: int) -> None:
        """The episode at this position begins."""
        self.close()
        self.pos, self.loaded = pos, set()

    def close(self) -> None:
        for i, (category, fact, episode, vector, active) in self.fresh.items():
            later = i in self.always or i in self.named
            self._tell("made", i, True, category, fact, episode, active, later, vector)
            if active and not later:
                del self.valid[i]
                insort(lasting := self.lasting.setdefault(vector, []), i)
                if len(lasting) > SIMILAR_FACTS:
                    self._drop(vector, lasting.pop())
        self.fresh = {}

    def _tell(self, what: str, i: str, made: bool, category=None, fact=None, source=None, active=None, later=None, vector=None) -> None:
        self.n += 1
        self.told.append((what, i, made, category, fact, source, self.n, active, later, vector))

    def _drop(self, vector: int, i: str) -> None:
        ids = self.usable[vector]
        del ids[bisect_left(ids, i)]

    def _end(self, i: str) -> None:
        vector, _, _, made = self.valid.pop(i)
        self._drop(vector, i)
        if i in self.fresh:
            self.fresh[i][-1] = False
        else:
            self._tell("ended", i, made)

    def _in_scope(self, i: str) -> bool:
        return i in self.valid and (i in self.always or i in self.loaded or i in self.fresh)

    def _duplicate(self, vector: int, excluded: str | None) -> str | None:
        left, a = SIMILAR_FACTS, 0
        vectors, ends = self.near.of(vector)
        for z in ends:
            firsts = [ids[: left + 1] for v in vectors[a:z] if (ids := self.usable.get(v))]
            a = z
            for i in firsts[0] if len(firsts) == 1 else islice(merge(*firsts), left + 1):
                if i == excluded:
                    continue
                if self._in_scope(i):
                    return i
                left -= 1
                if not left:
                    return None
        return None

    def act(self, episode: str, place: int, kind: str, fact: str, category: str, target: str, vector: int) -> None:
        hit = kind != "new" and self._in_scope(target)
        if kind in ("reinforce", "invalidate"):
            if hit and kind == "reinforce":
                self._reinforce(target, episode)
            elif hit:
                self._end(target)
            return
        found = self._duplicate(vector, target if hit else None)
        if hit:
            self._end(target)
        if found is not None:
            self._reinforce(found, episode)
        else:
            key = f"{episode}/{place}"
            if key in self.valid:
                self._end(key)
            self.add(key, vector, [episode], True)
            self.fresh[key] = [category, fact, episode, vector, True]

    def _reinforce(self, i: str, episode: str) -> None:
        x = self.valid[i]
        if episode != x[2] and episode not in x[1]:
            x[2] = episode
            self._tell("added", i, x[3], source=episode)


#: What a fold reads, in this order: the vectors of its actions (part 0), its facts and lists (1), then for each episode the facts loaded for it (step 0) and its actions (1).
_PARTS = "component string, part int, episode_pos long, step int, place long, row string, conversation_id string, id string, sources array<string>, embedding array<float>, class string, episode_id string, kind string, fact string, category string, target_fact_id string"
_ORDER = ("component", "part", "episode_pos", "step", "place")
#: What it tells: facts that are made (later: a later episode loads it), sources that are added, facts that are ended. made: of a fact that a fold made; n: the order.
_TOLD = "what string, id string, made boolean, category string, fact string, source string, n long, active boolean, later boolean, embedding array<float>, conversation_id string"
_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}


def _out(state: _State, conversation: str) -> pa.RecordBatch:
    """What the state has told since the last time."""
    told, state.told = state.told, []
    names = [x.rsplit(" ", 1) for x in _TOLD.split(", ")]
    columns = [pa.array(values, _TYPES[kind]) for (_, kind), values in zip(names, list(zip(*told))[:-1])]
    vectors = [None if x[-1] is None else state.near.rows[x[-1]].astype(np.float32) for x in told]
    columns += [pa.array(vectors, pa.list_(pa.float32())), pa.array([conversation] * len(told), pa.string())]
    return pa.RecordBatch.from_arrays(columns, [n for n, _ in names])


def _fold(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Components one after another, each row by row: what is held of one is its distinct vectors and the facts that it may change, not its actions."""
    component = conversation = state = None
    numbers: dict[str, int] = {}
    names = [x.split(" ")[0] for x in _PARTS.split(", ")]
    for batch in batches:
        for own, _, pos, _, place, row, conv, i, sources, vector, class_, episode, kind, fact, category, target in zip(*(batch.column(n).to_pylist() for n in names)):
            if own != component:
                if state is not None:
                    state.close()
                    if state.told:
                        yield _out(state, conversation)
                component, conversation, state, numbers = own, conv, _State(threshold), {}
            if pos is not None and pos != state.pos:
                state.open(pos)
            if row == "action":
                state.act(episode, place, kind, fact, category, target, numbers.get(class_, state.empty))
            elif row == "vector":
                numbers[class_] = state.near.add(vector)
            elif row in ("fact", "seen"):
                state.add(i, state.near.add(vector), sources or ())
            else:
                {"always": state.always, "named": state.named, "loaded": state.loaded}[row].add(i)
        if state is not None and state.told:
            yield _out(state, conversation)
    if state is not None:
        state.close()
        if state.told:
            yield _out(state, conversation)


def _classes(rows: DataFrame, kind: str) -> DataFrame:
    """conversation_id, embedding, class, copies: the distinct vectors of a conversation's rows, numbered."""
    found = rows.groupBy("conversation_id", "embedding").agg(F.count(F.lit(1)).alias("copies"))
    return stored(found.withColumn("class", F.concat(F.lit(kind), F.monotonically_increasing_id().cast("string"))))


def apply_actions(facts: DataFrame, actions: DataFrame, scope: DataFrame, threshold: float = DUPLICATE_SIMILARITY) -> DataFrame:
    """Normalised actions applied to the facts of their conversations, episode by episode; all facts come out, and new ones.

    facts: conversation_id, id, category, fact, sources, valid, embedding. actions: conversation_id, episode_id, episode_pos, place, kind, fact, category, target_fact_id, embedding.
    scope: conversation_id, episode_id (null: every episode), id of each fact loaded for it.

    The order of two actions matters only if they may touch one fact: a common target, or a fact that is near both or made by one and near the other.
    Actions and the facts they may change are split into components of these relations, which are folded apart. A fact that is loaded for
    no episode can't change; the nearest of those are shown to a component without joining it to others. Facts beside all components stay as they are.

    Vectors are compared once for each conversation, however many actions or facts have them; actions that only name a target hang on it. Texts of facts go past all this.
    """
    spark = facts.sparkSession
    ship(spark)

    def named(conversation: str, own: Column) -> Column:
        return F.concat_ws("\x00", F.col(conversation), own)

    own = F.concat(F.col("episode_id"), F.lit("/"), F.col("place").cast("string"))
    actions = stored(actions.withColumn("node", named("conversation_id", own)).withColumn("target", named("conversation_id", F.col("target_fact_id"))))
    facts = facts.withColumn("node", named("conversation_id", F.col("id")))
    bare = stored(facts.select("conversation_id", "id", "node", "sources", "valid", "embedding"))
    scope = scope.withColumn("node", named("conversation_id", F.col("id")))
    loaded = stored(scope.select("node").distinct())
    changing = bare.join(loaded, "node", "left_semi")
    fixed = bare.join(loaded, "node", "left_anti").filter("valid")

    near_by = threshold - 1e-9
    settling = actions.filter(F.col("kind").isin("new", "update"))
    asking, asked = _classes(settling, "p:"), _classes(changing.filter("valid"), "m:")
    probes = asking.select("conversation_id", F.col("class").alias("probe"), F.col("class").alias("exclude"), F.col("embedding").alias("vector"))
    members = asking.unionByName(asked).select("conversation_id", F.col("class").alias("member"), F.col("embedding").alias("vector"))
    near = stored(linked(probes, members, "conversation_id", near_by).filter("a <> b").distinct())
    # Copies are near each other if the vector is near itself.
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    selves = asking.filter("copies > 1").filter(length > near_by).select(F.col("class").alias("a"), F.concat(F.lit("l:"), "class").alias("b"))
    joined = near.select(F.col("a").alias("class")).union(near.select("b")).union(selves.select("a")).distinct()

    def with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
        """rows with class, and rep: the class if its rows belong together, else the row's own name."""
        known = stored(classes.select("conversation_id", "embedding", "class").join(joined.withColumn("together", F.lit(True)), "class", "left"))
        met = rows.join(known, ["conversation_id", "embedding"], "left").drop("embedding")
        return met.withColumn("rep", F.when(F.col("together"), F.col("class")).otherwise(F.concat(F.lit("n:"), F.col("node")))).drop("together")

    settled = with_class(settling, asking)
    placed_facts = stored(with_class(changing.filter("valid"), asked).select("node", "rep"))
    listed = loaded.join(placed_facts, "node", "left").select("node", F.coalesce("rep", F.concat(F.lit("n:"), "node")).alias("rep"))
    reps = stored(listed.unionByName(settled.select("node", "rep")).groupBy("node").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")))
    targets = reps.select(F.col("node").alias("target"), F.col("rep").alias("target_rep"))
    aiming = actions.filter("kind <> 'new' AND target_fact_id <> ''").select("node", "target").join(targets, "target").select("node", "target_rep")
    marked = stored(settled.unionByName(actions.filter(~F.col("kind").isin("new", "update")).drop("embedding"), allowMissingColumns=True).join(stored(aiming), "node", "left"))
    aimed = marked.filter("target_rep IS NOT NULL")
    edges = near.unionByName(selves).unionByName(reps.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    edges = edges.unionByName(aimed.filter("rep IS NOT NULL").select(F.col("rep").alias("a"), F.col("target_rep").alias("b")).distinct())
    edges = edges.unionByName(aimed.select(F.col("target_rep").alias("a"), F.concat(F.lit("l:"), "target_rep").alias("b")).distinct())
    roots = stored(components(edges)).select(F.col("node").alias("__n"), F.col("root").alias("component"))

    def placed(rows: DataFrame, by: Column, how: str = "inner") -> DataFrame:
        return rows.join(roots, by == F.col("__n"), how).drop("__n")

    marked = stored(placed(marked, F.coalesce("rep", "target_rep"), "left"))
    # What meets nothing makes a fact, or does nothing.
    alone = marked.filter("component IS NULL AND kind IN ('new', 'update')").join(asking.select("class", "embedding"), "class", "left")
    made = alone.select("conversation_id", own.alias("id"), "category", "fact", F.lit(1).alias("source_count"), F.lit(True).alias("active"), F.array("episode_id").alias("sources"), F.col("embedding").cast("array<float>").alias("embedding"))
    acting = marked.filter("component IS NOT NULL")
    touched = stored(acting.select("component").distinct())
    inside = placed(changing.filter("valid").join(reps.select("node", "rep"), "node"), F.col("rep")).join(touched, "component", "left_semi")
    acting_classes = stored(acting.filter("class IS NOT NULL").select("class", "component").distinct())
    shown = above(probes.join(acting_classes, F.col("probe") == F.col("class"), "left_semi"), fixed.select("conversation_id", F.col("node").alias("member"), F.col("embedding").alias("vector")), "conversation_id", SIMILAR_FACTS, near_by)
    seen = shown.join(acting_classes, F.col("probe") == F.col("class")).select("component", F.col("member").alias("node")).distinct().join(fixed, "node").drop("sources")
    lists = placed(scope.join(reps.select("node", "rep"), "node"), F.col("rep")).join(touched, "component", "left_semi")
    own_lists = stored(lists.filter("episode_id IS NOT NULL").select("component", "conversation_id", "episode_id", "id"))
    # An episode's own list comes with its first action in the component.
    opening = acting.groupBy("component", "episode_pos").agg(F.min_by("episode_id", "place").alias("episode_id"))
    parts = None
    for row, part, table in (
        ("vector", 0, acting_classes.join(asking, "class")), ("fact", 1, inside), ("seen", 1, seen), ("always", 1, lists.filter("episode_id IS NULL")), ("named", 1, own_lists.drop("episode_id").distinct()),
        ("loaded", 2, own_lists.join(opening, ["component", "episode_id"])), ("action", 2, acting),
    ):
        table = table.withColumns({"row": F.lit(row), "part": F.lit(part), "step": F.lit(int(row == "action"))})
        columns = [F.col(n).cast(k).alias(n) if n in table.columns else F.lit(None).cast(k).alias(n) for n, k in (x.rsplit(" ", 1) for x in _PARTS.split(", "))]
        parts = table.select(*columns) if parts is None else parts.unionByName(table.select(*columns))
    ordered = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "component").sortWithinPartitions(*_ORDER)
    told = stored(ordered.mapInArrow(lambda batches: _fold(batches, threshold), _TOLD)).withColumn("node", named("conversation_id", F.col("id")))
    # A source counts once, at its first place; what has none is an end.
    sources = told.filter("what <> 'made'").groupBy("node", "made", "source").agg(F.min("n").alias("n"))
    changes = sources.groupBy("node", "made").agg(
        F.count("source").cast("int").alias("__more"), F.bool_or(F.col("source").isNull()).alias("__ended"), F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("n", "source")))).alias("__added")
    )
    new = told.filter("what = 'made'").select("conversation_id", "id", "node", "category", "fact", F.array("source").alias("sources"), F.col("active").alias("valid"), "embedding", "later")
    again = new.select("node").join(bare.select("node"), "node", "left_semi")  # facts that are made once more

    def changed(rows: DataFrame, by: DataFrame) -> DataFrame:
        return rows.join(by.drop("made"), "node", "left").select(
            "node", "conversation_id", "id", "category", "fact", (F.size("sources") + F.coalesce("__more", F.lit(0))).alias("source_count"), (F.col("valid") & ~F.coalesce("__ended", F.lit(False))).alias("active"),
            F.when(F.col("__more") > 0, F.concat("sources", F.transform("__added", lambda x: x["source"]))).otherwise(F.col("sources")).alias("sources"), F.col("embedding").cast("array<float>").alias("embedding"),
        )

    left = changed(facts, changes.filter("NOT made")).join(again, "node", "left_anti").drop("node")
    renewed = changed(new.filter("later"), changes.filter("made")).drop("node")
    final = new.filter("NOT later").select("conversation_id", "id", "category", "fact", F.size("sources").alias("source_count"), F.col("valid").alias("active"), "sources", "embedding")
    return final.unionByName(renewed).unionByName(made).unionByName(left)
