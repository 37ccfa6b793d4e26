import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palim.llm import decontamination, sentencepiece_codec, sharding
from palim.llm.common import utf8
from tests.llm.helpers import awkward, documents, empty, prose

# Sharding


def _placed(spark, texts, shards=8):
    return sharding.shard_documents(documents(spark, texts), shards).collect()


def test_shards_are_near_equal_in_bytes(spark):
    texts = [prose(i, 1 + i * 7 % 90) for i in range(400)]
    rows = _placed(spark, texts)
    assert len(rows) == 400
    size = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], minlength=8)
    assert size.max() - size.min() <= 2 * max(len(t) + 1 for t in texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_equal_texts_stay_together_unless_they_outweigh_a_shard(spark):
    few = [prose(i % 60, 30) for i in range(240)]
    by_text = {}
    for r in _placed(spark, few):
        by_text.setdefault(few[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in by_text.values()) <= 7  # a group of four is at most at one of the seven cuts
    many = [prose(1, 30)] * 150 + [prose(i, 30) for i in range(2, 152)]
    rows = _placed(spark, many)
    size = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], minlength=8)
    assert size.max() < 1.25 * size.min()


def test_only_the_heavy_text_is_cut_by_id(spark):
    heavy = prose(1, 30)
    texts = [heavy] * 300 + [prose(2 + i % 300, 20 + i % 20) for i in range(600)]
    rows = _placed(spark, texts)
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert {t for t, shards in by_text.items() if len(shards) > 1} == {heavy}
    size = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], minlength=8)
    assert size.max() < 1.2 * size.min()


def test_sharding_awkward_rows(spark):
    docs = awkward(spark)
    got = sharding.shard_documents(docs)
    assert got.count() == docs.count()
    assert got.filter("doc_id = 60 AND size = 1 AND text_crc32 = 0").count() == 1
    assert sharding.shard_documents(empty(spark)).count() == 0
    assert _placed(spark, ["a"])[0]["slot"] == 0


# SentencePiece


@pytest.fixture(scope="module")
def model():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces(model):
    return sentencepiece_codec.Pieces.load(model)


@pytest.fixture(scope="module")
def reference(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def _encode(pieces, texts):
    ids, bounds = sentencepiece_codec.encode_block(pieces, *utf8(pa.array(texts, pa.large_string())))
    return [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])]


@settings(max_examples=120, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("the and ing of  \n\t"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=6))
def test_encoding_equals_the_library(pieces, reference, texts):
    assert _encode(pieces, texts) == [reference.encode(t) for t in texts]


def test_long_words_equal_the_library(pieces, reference):
    texts = ["x" * 500, "supercalifragilistic" * 30, "日本語の長い文章" * 40, "https://example.com/" + "a1b2c3" * 50, "é" * 200 + " ok"]
    assert _encode(pieces, texts) == [reference.encode(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="▁"), max_size=50), min_size=1, max_size=5))
def test_round_trip(pieces, texts):
    ids, bounds = sentencepiece_codec.encode_block(pieces, *utf8(pa.array(texts, pa.large_string())))
    data, off = sentencepiece_codec.decode_block(pieces, ids, bounds)
    raw = data.tobytes()
    assert [raw[a:z].decode() for a, z in zip(off[:-1], off[1:])] == texts


def test_codec_awkward_rows(spark, model):
    docs = awkward(spark)
    encoded = sentencepiece_codec.encode(docs, model)
    assert encoded.columns == [c for c in docs.columns if c != "pieces"] + ["pieces"]
    both = sentencepiece_codec.decode(encoded, model)
    assert both.filter("decoded <> coalesce(text, '') AND NOT contains(text, '▁')").count() == 0
    assert both.count() == docs.count()
    got = sentencepiece_codec.digests(docs, model)
    assert got.filter("NOT round_trip").count() == 1  # the mark itself decodes to a space
    assert sentencepiece_codec.digests(empty(spark), model).count() == 0


# Decontamination

QUESTION = "A farmer named Tom sells 12 baskets of ripe apples at the small market for 3 dollars each while his friend Tom keeps 12 more baskets at home for the winter"
OTHER = QUESTION.replace("Tom", "Anna").replace("12", "45").replace("3 ", "7 ")
ALTERED = QUESTION.replace("sells 12", "sells 45").replace("Tom sells", "Anna sells")  # 12 becomes 45 once, stays 12 once; 18 words in a row are the item's
BROKEN = ALTERED.replace("3 dollars", "7 dollars").replace("friend Tom keeps 12", "friend Max keeps 50")  # two values each, and nowhere 13 words of the item


def _found(spark, texts, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contaminated(documents(spark, texts), benchmark).collect()
    return {(r["doc_id"], r["item_id"]): r["n_changed"] for r in rows}


def test_copies_and_other_parameters_are_found(spark):
    texts = [f"{prose(1, 30)}\n{QUESTION}. {prose(2, 30)}", f"{prose(3, 10)} {OTHER}", prose(4, 200), BROKEN, " ".join(QUESTION.split()[:9]), f"{QUESTION.lower().replace('tom', 'Tom')}!"]
    got = _found(spark, texts, [(7, QUESTION), (9, prose(50, 30)), (5, None), (None, QUESTION), (3, "too short")])
    assert {k: bool(v) for k, v in got.items() if k[0] in (0, 1)} == {(0, 7): False, (1, 7): True}
    assert (3, 7) not in got
    assert not {k for k in got if k[0] in (2, 4)}
    assert got[5, 7] >= 0
    assert _found(spark, [ALTERED, BROKEN], [(7, QUESTION)]).keys() == {(0, 7)}


def brute_passages(texts, items):
    """Documents and items that share 13 plain words in a row (no slots in these fixtures)."""
    def words(t):
        return [w for w in "".join(c if c.isalnum() or c.isspace() else "" for c in t).split()]

    out = set()
    for d, t in enumerate(texts):
        grams = {tuple(words(t)[i : i + 13]) for i in range(len(words(t)) - 12)}
        for i, x in items:
            w = words(x)
            if any(tuple(w[j : j + 13]) in grams for j in range(len(w) - 12)):
                out.add((d, i))
    return out


NAMES = ["Tom", "Max Smith", "Eva Marie Jones", "Ann", "Karl Ludwig", "José"]
AMOUNTS = ["12", "40 km", "seven", "1500 dollars", "twenty", "3 kg", "x9", "Two"]
FRAMES = [
    "the teacher {0} asks {1} to carry {2} of sand from the yard of {0} to the house before {0} and {1} bring {3} more of it home",
    "on the way to school {0} finds {2} of rope and gives {3} to {1} who then sells it to {0} again for a better price",
    "der lehrer {0} fragt {1} nach {2} sand und bringt danach noch {3} davon mit weil {1} und {0} heute nichts mehr zu tun haben",
]


def brute_templates(texts, items):
    """(document, item) pairs by a walk over the words: slots of any length between equal words, a value of the item having one value in the text (or 13 words in a row equal)."""
    import re

    from palim.llm.decontamination import _NUMBER_WORDS, _UNITS

    numbers, units = set(_NUMBER_WORDS.split()), set(_UNITS.split())

    def template(t):
        words, out, i = "".join(c if c.isalnum() or c.isspace() else "" for c in t).split(), [], 0
        is_number = lambda w: any(c.isnumeric() for c in w) or w.lower() in numbers
        while i < len(words):
            j = i + 1
            if is_number(words[i]):
                j += j < len(words) and words[j].lower() in units
                out.append(("#", " ".join(words[i:j])))
            elif words[i][0].isupper():
                while j < len(words) and words[j][0].isupper() and not is_number(words[j]):
                    j += 1
                out.append(("@", " ".join(words[i:j])))
            else:
                out.append((words[i], words[i]))
            i = j
        return out

    found = set()
    for d, t in enumerate(texts):
        doc = template(t)
        for k, x in items:
            item = template(x)
            for s in range(len(doc) - len(item) + 1):
                part = doc[s : s + len(item)]
                if [a for a, _ in part] == [a for a, _ in item]:
                    pairs = {(b, c) for (_, b), (a, c) in zip(item, part) if a in "#@"}
                    same = "".join("01"[b == c] for (_, b), (_, c) in zip(item, part))
                    if len(pairs) == len({b for b, _ in pairs}) or "1" * min(13, len(item)) in same:
                        found.add((d, k))
    return found


def test_slots_of_other_lengths_match_brute_force(spark):
    rng = np.random.default_rng(4)

    def fill(i, names, consistent=True):
        n, a = rng.permutation(names), rng.permutation(AMOUNTS)
        text = FRAMES[i].format(n[0], n[1], a[0], a[1])
        return text if consistent else FRAMES[i].replace("{0} again", "{4} again").replace("und {0}", "und {4}").replace("before {0}", "before {4}").format(n[0], n[1], a[0], a[1], n[2])

    items = [(i, fill(i, NAMES[:3])) for i in range(3)]
    texts = [f"{letters(100 + i, 9)} {fill(i % 3, NAMES[3:], i % 4 > 0)} {letters(200 + i, 7)}" for i in range(48)] + [letters(300, 50)]
    want = brute_templates(texts, items)
    assert 30 <= len(want) < 48
    assert set(_found(spark, texts, items)) == want


def letters(seed, n):
    return prose(seed, n).translate(str.maketrans("0123456789", "abcdefghij"))


def test_plain_passages_match_brute_force(spark):
    items = [(i, letters(500 + i, 14 + i)) for i in range(12)]
    texts = []
    for i in range(60):
        t = letters(i, 60)
        if i % 3 == 0:
            t = f"{letters(900 + i, 15)}, {items[i % 12][1]} {t}"
        if i % 5 == 0:
            t += " " + " ".join(items[(i + 1) % 12][1].split()[: 11 + i % 4])
        texts.append(t)
    assert set(_found(spark, texts, items)) == brute_passages(texts, items)


def test_decontamination_awkward_rows(spark):
    docs = awkward(spark)
    benchmark = spark.createDataFrame([(1, docs.filter("doc_id = 3").first()["text"], 9)], "item_id long, text string, doc_id long")
    got = {r["doc_id"] for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == {3, 65, 66}
    assert decontamination.contaminated(empty(spark), benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0


def test_copies_in_another_case_are_found(spark):
    texts = [f"{prose(1, 30)} {QUESTION.upper()}", f"{prose(2, 30)} {QUESTION.lower()} and", QUESTION.title(), f"{prose(3, 9)} {QUESTION.upper().replace('12', '45')}", prose(4, 60).upper()]
    got = _found(spark, texts, [(7, QUESTION), (9, QUESTION.upper().replace("TOM", "ANN"))])
    assert {k: bool(v) for k, v in got.items() if k[1] == 7} == {(0, 7): False, (1, 7): False, (2, 7): False, (3, 7): True}


def test_each_item_of_a_template_is_checked_by_its_own_values(spark):
    ask = "a shop has {} apples in the red box and also keeps {} pears under the long table by the door of the kitchen"
    items = [(1, ask.format(12, 12)), (2, ask.format(12, 15)), (3, ask.format(20, 30))]
    got = _found(spark, [items[1][1], items[0][1], ask.format(7, 7)], items)
    assert got[0, 2] == 0 and (0, 1) not in got and got[0, 3] == 2
    assert got[1, 1] == 0 and got[1, 2] == 1  # two values of an item may have one value in the document
    assert got[2, 1] == 2


def test_verbatim_copies_are_found_whatever_their_slots(spark):
    numbers = "add 12 45 7 and 9 81 30 then 6 8 10 44 to 71 90 52"
    items = [(1, numbers), (2, "GIVE THE 3 LARGEST OF 4 9 16 25 36 49 64"), (3, "Name all prime factors"), (4, numbers.replace("30", "33")), (5, "")]
    texts = [f"{prose(1, 20)} {numbers}", f"so {items[1][1].lower()} it is", f"{prose(2, 9)} name all prime factors.", numbers.replace("30", "31"), "Name all the prime factors"]
    assert set(_found(spark, texts, items)) == {(0, 1), (1, 2), (2, 3)}


def test_numbers_inside_words_are_slots(spark):
    ask = "let n=12 be the side and x+3 be the height of a box then find f(2) for the whole box when y=4 holds"
    other = ask.replace("12", "15").replace("+3", "+9").replace("(2)", "(7)").replace("y=4", "y=8")
    got = _found(spark, [f"{prose(1, 20)} {other}", ask, other.replace("box", "jar")], [(1, ask)])
    assert got == {(0, 1): 4, (1, 1): 0}


def test_segments_stand_for_template_words(spark):
    texts = [QUESTION, OTHER, f"{NAMES[2]} Two Three miles A12 x {AMOUNTS[3]} USD30 {NAMES[4]} 9", "Ünder Öl 12 Tage fünf Jahre ß ǅ é ", "", prose(3, 80), FRAMES[2].format(*NAMES[:2], *AMOUNTS[:2])]
    plain = spark.createDataFrame([(t,) for t in texts], "t string").select(decontamination._plain(F.col("t")).alias("p")).select("p", decontamination._typed(F.col("p")).alias("typed"))
    for form in range(3):
        for r in plain.select(decontamination._split(decontamination._template(form, F.col("p"), F.col("typed"))).alias("w"), decontamination._segments(form, F.col("p")).alias("v"), "p").collect():
            assert len(r["w"]) == len(r["v"]) and " ".join(r["v"]) == r["p"]


def test_rows_without_an_id_or_with_one_id_are_judged_by_their_own_text(spark):
    rows = [(None, QUESTION), (None, prose(1, 40)), (5, f"{prose(2, 9)} {OTHER}"), (5, prose(3, 40)), (6, None), (None, None), (7, QUESTION), (7, QUESTION)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS text_hash", "1 AS item_id")
    benchmark = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    kept = decontamination.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted((str(a), str(b)) for a, b in (rows[1], rows[3], rows[4], rows[5]))


def test_short_questions_are_found_word_for_word(spark):
    items = [(1, "What is 12 plus 7"), (2, "Who wrote the letter"), (3, "Anna Bell Carl Dorn Emil Falk Gina Hart Igor Jung Kurt Lenz Mia Noll Olga Paul")]
    texts = [f"{prose(1, 20)} What is 12 plus 7? {prose(2, 9)}", "what is 12 plus 8", f"x {items[2][1]} y", "who wrote the letter"]
    assert set(_found(spark, texts, items)) == {(0, 1), (2, 3), (3, 2)}


def test_very_long_runs_of_names(spark):
    """A text of 200,000 capitalised words is one name between two words, and an item behind it is still found."""
    texts = [f"so {'Anna Bell ' * 100_000} {QUESTION}", "Anna " * 200_000, f"A {'1 ' * 100_000}"]
    assert _found(spark, texts, [(7, QUESTION)]) == {(0, 7): 0}
