"""Benchmark decontamination by template windows, in DataFrame functions alone.

Numbers (with their units) and names become typed placeholders, on both sides alike: a number and the unit behind it are
one placeholder, and so is a run of capitalised words, so that a slot may be filled by fewer or more words. Windows of
WINDOW template words meet by hash. A second form keeps names, in lower case like all words, so that copies in another
case meet too. Windows of one document and one item that stand at the same distance, in template words, are a passage.
Its slots (what the placeholders replaced) must be consistent: each value of the item has one value in the document
wherever it occurs. So a question asked with other numbers and names is found, and a text that only shares its grammar
isn't. A passage with COVER words in a row just like the item's is a copy, whatever became of its other slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palim.llm.common import materialise, small

WINDOW = 8
#: Words of a window that must not be placeholders; an item with other windows is also sought word for word.
LITERALS = 4
#: Words of an item that a passage must cover: these, or all of a shorter item.
COVER = 13
#: Benchmark windows up to which they are broadcast (16 bytes each); beyond, both sides are shuffled by hash.
BROADCAST_WINDOWS = 1_000_000

NUMBER, NAME = "#", "@"
#: Number words and units of the languages that benchmarks are asked in here (English, French, German, Spanish). "One" and its like are articles and pronouns as well.
_NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend "
    "dos tres cuatro cinco seis siete ocho nueve diez doce quince veinte treinta cuarenta cincuenta cien ciento mil"
)
_UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years kmh mph percent dollar dollars cent cents euro euros usd eur "
    "jour jours heure heures semaine semaines mois an ans mètre mètres kilomètre kilomètres gramme grammes tag tage tagen stunde stunden minuten woche wochen monat monate jahr jahre jahren kilometern gramm prozent "
    "hora horas minuto minutos día días semana semanas mes meses año años metro metros kilómetro kilómetros gramo gramos litro litros"
)


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, common beginnings written once."""
    tails: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        tails.setdefault(w[:1], []).append(w[1:])
    if list(tails) == [""]:
        return ""
    inner = "|".join(first + (_any_of(rest) if first else "") for first, rest in sorted(tails.items(), reverse=True))
    return f"(?:{inner})" if len(tails) > 1 else inner


#: A word that is a number, a unit behind it, and a word that begins with a capital; a word is what stands between spaces.
_NUMBER = rf"(?:[^ \p{{N}}]*+\p{{N}}[^ ]*|(?i:{_any_of(_NUMBER_WORDS.split())})(?![^ ]))"
_UNIT = rf"(?: (?i:{_any_of(_UNITS.split())})(?![^ ]))"
_CAPITAL = r"\p{Lu}[^ ]*+"


def _plain(text: Column) -> Column:
    """The text without signs, its words apart by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\s]+", ""), r"\s+", " "))


def _typed(plain: Column) -> Column:
    """Numbers, with the units behind them, to placeholders.

    Each pattern begins with the space before a word, which a search finds faster than a look behind; a space leads the text.
    """
    return F.regexp_replace(F.concat(F.lit(" "), plain), f" {_NUMBER}{_UNIT}?", f" {NUMBER}")


#: Forms of a text, by number, from its typed and its plain text; the last has no placeholders. Windows and passages are of one form.
CANONICAL, CASELESS, VERBATIM = range(3)


def _template(form: int, plain: Column, typed: Column) -> Column:
    if form == CANONICAL:
        return F.regexp_replace(typed, f"(?: {_CAPITAL})++", f" {NAME}")  # possessive: a run of any length is matched in a loop, not by recursion
    return F.lower(typed if form == CASELESS else plain)


def _segments(form: int, plain: Column) -> Column:
    """What each template word of _template stands for, as an array."""
    if form == VERBATIM:
        return _split(plain)
    name = rf"|{_CAPITAL}(?: (?!{_NUMBER}){_CAPITAL})*+" if form == CANONICAL else ""
    return F.regexp_extract_all(plain, F.lit(rf"(?<![^ ])(?:{_NUMBER}{_UNIT}?{name}|[^ ]+)"), F.lit(0))


def _is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME)


def _split(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _bound(value: Column, f) -> Column:
    """f(value), value being bound to a lambda's variable: it is made once a row, not once for each use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _windows(words: Column, form: int, length: int = WINDOW) -> Column:
    """Hashes of all windows of an array, by place. Those of WINDOW words are made of pairs of words, of fours, of eights."""

    def joined(hashes: Column, step: int, *seed: Column) -> Column:
        return _bound(hashes, lambda w: F.zip_with(w, F.slice(w, 1 + step, F.size(w)), lambda a, b: F.xxhash64(*seed, a, b)))

    out = F.transform(words, lambda x: F.xxhash64(x))
    if length == WINDOW:
        out = joined(joined(joined(out, 1), 2), WINDOW // 2, F.lit(form))
    else:
        out = _bound(out, lambda w: F.transform(w, lambda x, i: F.xxhash64(F.lit(form), F.lit(length), x, *[F.get(w, i + k) for k in range(1, length)])))
    return _bound(out, lambda w: F.slice(w, 1, F.greatest(F.size(w) - (length - 1), F.lit(0))))


def _literals(words: Column, place: Column) -> Column:
    """Words of the window at a place that are no placeholders."""
    return F.size(F.filter(F.slice(words, place + 1, WINDOW), lambda w: ~_is_slot(w)))


def templates(benchmark: DataFrame) -> DataFrame:
    """form, item_id, words, values, lead of each distinct item in each form: its template and what each word of that stands for; lead is the least item_id of those that differ in slots only, whose windows are the same.

    Equal items are one, under the least id. The verbatim form, by which a copy is found whatever its share of slots, is
    for items of fewer than WINDOW words in some form and for those with windows of fewer than LITERALS literals. Shorter
    templates with LITERALS literals are sought whole. Null text is empty and gives nothing; a null id never names a template.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _plain(F.col("text")).alias("plain")).filter("item_id IS NOT NULL")
    items = items.groupBy("plain").agg(F.min("item_id").alias("item_id")).withColumn("typed", _typed(F.col("plain")))
    forms = [F.struct(_template(i, F.col("plain"), F.col("typed")).alias("template"), _segments(i, F.col("plain")).alias("values")) for i in (CANONICAL, CASELESS, VERBATIM)]
    items = items.select("item_id", _split(_template(CASELESS, F.col("plain"), F.col("typed"))).alias("typed"), F.posexplode(F.array(*forms)).alias("form", "x"))
    leads = items.groupBy("form", F.col("x.template").alias("template")).agg(F.min("item_id").alias("lead"))
    items = items.select("*", F.col("x.template").alias("template"), "x.values").join(leads, ["form", "template"])
    items = items.select("form", "item_id", _split(F.col("template")).alias("words"), "values", "lead", "typed")
    dense = F.exists(F.sequence(F.lit(0), F.greatest(F.size("typed") - WINDOW, F.lit(0))), lambda i: _literals(F.col("typed"), i) < LITERALS)
    verbatim = (F.size("words") > 0) & ((F.size("typed") < WINDOW) | dense)
    whole = F.size(F.filter("words", lambda w: ~_is_slot(w))) >= LITERALS
    return items.filter(F.when(F.col("form") == VERBATIM, verbatim).otherwise((F.size("words") >= WINDOW) | whole)).drop("typed")


def row_key() -> list[Column]:
    """What tells rows apart that have a null id, or one id and different texts."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")]


def passages(docs: DataFrame, benchmark: DataFrame, cover: int = COVER) -> DataFrame:
    """doc_id, text_hash, item_id, form, first_word, n_words, n_slots, n_changed, shift: a row for each passage (item, distance and form) that covers at least `cover` template words of an item (or all of it) and is a copy or consistent.

    n_changed counts slots with another value than the item's: 0 is a copy, more a re-parameterised question. Null text is
    empty. Rows with a null or a repeated doc_id are told apart by their texts; rows with equal id and text count as one.
    An empty side gives no rows. A name at either end of a passage may run on into the text around it, so only what meets
    the item is compared there.
    """
    items = materialise(templates(benchmark))
    length = F.least(F.size("words"), F.lit(WINDOW))
    kinds = sorted((r["form"], r["length"]) for r in items.select("form", length.alias("length")).distinct().collect()) or [(0, WINDOW)]
    hashes = F.coalesce(*[F.when((F.col("form") == i) & (length == n), _windows(F.col("words"), i, n)) for i, n in kinds])
    item_windows = materialise(
        items.filter("item_id = lead").select("form", "lead", "words", F.posexplode(hashes).alias("item_place", "hash"))
        .filter((F.col("form") == VERBATIM) | (_literals(F.col("words"), F.col("item_place")) >= LITERALS))
        .select("hash", "form", "lead", "item_place")
    )
    if item_windows.count() <= BROADCAST_WINDOWS:
        item_windows = F.broadcast(item_windows)
    plain = docs.select(*row_key(), _plain(F.col("text")).alias("plain"))
    typed = plain.withColumn("typed", _typed(F.col("plain")))
    spread = typed.select("doc_id", "text_hash", F.explode(F.array(*[_windows(_split(_template(i, F.col("plain"), F.col("typed"))), i, n) for i, n in kinds])).alias("hashes"))
    met = spread.select("doc_id", "text_hash", F.posexplode("hashes").alias("place", "hash")).join(item_windows, "hash")
    # Covered words: each window adds those past the end of the window before it.
    chains = met.select("doc_id", "text_hash", "form", "lead", (F.col("place") - F.col("item_place")).alias("shift"), "item_place").distinct()
    chains = chains.groupBy("doc_id", "text_hash", "form", "lead", "shift").agg(F.sort_array(F.collect_list("item_place")).alias("places"))  # at most the item's windows
    covered = F.lit(WINDOW) + F.aggregate(
        F.zip_with(F.slice("places", 2, F.size("places")), F.slice("places", 1, F.size("places") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda s, x: s + x
    )
    chains = chains.withColumn("covered", F.when(F.size("places") > 1, covered).otherwise(F.lit(WINDOW)))
    enough = materialise(
        chains.join(items.select("form", "item_id", F.size("words").alias("size"), "words", F.col("values").alias("theirs"), "lead"), ["form", "lead"])  # each item of the template is checked by its own values
        .withColumn("covered", F.least("covered", "size"))
        .withColumn("due", F.least(F.lit(cover), F.col("size")))
        .filter(F.col("covered") >= F.col("due"))
    )
    # Slots: values of the item beside those of the document, over the covered words.
    wanted = small(materialise(enough.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()))  # texts stay where they are
    same_row = (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    sources = plain.join(wanted, same_row, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    sources = materialise(sources.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.array(*[_segments(i, F.col("plain")) for i in (CANONICAL, CASELESS, VERBATIM)]).alias("forms")))
    both = enough.join(sources, same_row).withColumn("own", F.get("forms", F.col("form"))).drop("forms")
    inside = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, F.least(p + WINDOW, F.col("size")) - 1))))
    both = both.withColumn("inside", inside).withColumn("first", F.array_min("inside")).withColumn("last", F.array_max("inside"))

    def folded(value: Column) -> Column:
        return F.when(F.col("form") == CANONICAL, value).otherwise(F.lower(value))

    def row(i: Column) -> Column:
        theirs, own = folded(F.get("theirs", i)), folded(F.get("own", i + F.col("shift")))
        name = F.get("words", i) == NAME
        runs_in = (i == F.col("first")) & name & F.endswith(own, F.concat(F.lit(" "), theirs))
        runs_on = (i == F.col("last")) & name & F.startswith(own, F.concat(theirs, F.lit(" ")))
        return F.struct(
            i.alias("i"), _is_slot(F.get("words", i)).alias("slot"), (name & ((i == F.col("first")) | (i == F.col("last")))).alias("edge"), theirs.alias("item"), own.alias("own"),
            F.coalesce((theirs == own) | runs_in | runs_on, F.lit(False)).alias("same"),
        )

    both = both.withColumn("pairs", F.transform("inside", row))
    exact = F.forall("pairs", lambda p: p["slot"] | p["same"])  # words that aren't slots are equal, not just their hashes
    slots = F.filter("pairs", lambda p: p["slot"])
    inner = F.array_distinct(F.transform(F.filter(slots, lambda p: ~p["edge"] | p["same"]), lambda p: F.struct(p["item"].alias("item"), F.when(p["same"], p["item"]).otherwise(p["own"]).alias("own"))))
    both = both.withColumn("slots", slots).withColumn("values", inner).withColumn("like", F.transform(F.filter("pairs", lambda p: p["same"]), lambda p: p["i"]))
    consistent = F.size("values") == F.size(F.array_distinct(F.transform("values", lambda v: v["item"])))
    copied = F.exists(F.transform("like", lambda x, k: F.get("like", k + F.col("due") - 1) - x == F.col("due") - 1), lambda x: F.coalesce(x, F.lit(False)))
    return (
        both.filter(exact & (consistent | copied))
        .select(
            "doc_id", "text_hash", "item_id", "form", (F.col("first") + F.col("shift")).alias("first_word"), F.col("covered").alias("n_words"), F.size("slots").alias("n_slots"),
            F.size(F.filter("slots", lambda p: ~p["same"])).alias("n_changed"), "shift",
        )
        .distinct()
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_passages, n_words, n_changed: one row for each document and item it holds (of a template, all items whose values are consistent), with the longest passage's words and the least changes. Rows with one id are one document here, a null id is one too."""
    found = passages(docs, benchmark)
    return found.groupBy("doc_id", "item_id").agg(
        F.countDistinct("text_hash", "shift").alias("n_passages"), F.max("n_words").cast("long").alias("n_words"), F.min("n_changed").cast("long").alias("n_changed")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose text holds no benchmark item. Each row is judged by its own text, whatever its id: null, or repeated."""
    found = passages(docs, benchmark)
    gone = materialise(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    return docs.join(small(gone), (F.xxhash64(docs["text"]) == F.col("__hash")) & docs["doc_id"].cast("long").eqNullSafe(F.col("__id")), "left_anti")


def op4_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """All of `documents` against all of `benchmark`: doc_id, item_id, n_passages, n_words, n_changed. A document without a passage has no row; null and empty texts have none."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
