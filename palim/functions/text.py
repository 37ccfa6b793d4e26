"""Text expressions: tokens, rendering, normalisation. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palim.schemas import CATEGORIES, KEY_MOMENT


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search_text(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def hour_header(ts: Column) -> Column:
    return F.concat(F.lit("Spoken At: "), F.date_format(ts, "MMM d, yyyy h a"))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def transcript(messages: Column) -> Column:
    """messages: array of (seq, role, content, ts) in order. A header opens each run of lines of one hour."""

    def piece(m: Column, i: Column) -> Column:
        hour = F.date_trunc("hour", m["ts"])
        before = F.date_trunc("hour", F.get(messages, i - 1)["ts"])
        line = F.concat(m["role"], F.lit(": "), collapse_space(m["content"]))
        return F.when(i == 0, F.concat(hour_header(m["ts"]), F.lit("\n"), line)).when(hour != before, F.concat(F.lit("\n\n"), hour_header(m["ts"]), F.lit("\n"), line)).otherwise(F.concat(F.lit("\n"), line))

    return F.regexp_replace(F.array_join(F.transform(messages, piece), ""), r"(?U)\s+$", "")


def message_lines(messages: Column, style: str = "numbered") -> Column:
    """Prompt lines: `numbered` (Message i [ts] role: text), `indexed` (- [idx=i] ts [role] text), `plain` (role: text)."""

    def line(m: Column, i: Column) -> Column:
        if style == "numbered":
            return F.concat(F.lit("Message "), (i + 1).cast("string"), F.lit(" ["), utc_text(m["ts"]), F.lit("] "), m["role"], F.lit(": "), m["content"])
        if style == "indexed":
            return F.concat(F.lit("- [idx="), i.cast("string"), F.lit("] "), utc_text(m["ts"]), F.lit(" ["), m["role"], F.lit("] "), m["content"])
        return F.concat(m["role"], F.lit(": "), m["content"])

    return F.array_join(F.transform(messages, line), "\n")


def normalize_category(raw: Column) -> Column:
    value = F.lower(F.trim(raw))
    return F.when(value.isin(*CATEGORIES), value).otherwise("identity")


def parse_rating(raw: Column) -> Column:
    value = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(value.isin("again", "hard", "easy"), value).otherwise("good")


def answer_tokens(text: Column) -> Column:
    """ASCII answer tokens without articles."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin("a", "an", "and", "the"))


def set_tokens(text: Column) -> Column:
    """Distinct tokens split at spaces, with sentence signs as spaces."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[.,!?]", " "), r"\s+"), lambda w: w != ""))


def judge_label(raw: Column) -> Column:
    first = F.split(F.upper(F.trim(F.coalesce(raw, F.lit("")))), r"\s+")[0]
    return F.when(first == "CORRECT", 1.0).when(first == "PARTIAL", 0.5).otherwise(0.0)


def verdict(raw: Column) -> Column:
    return F.when(F.startswith(F.upper(F.trim(F.coalesce(raw, F.lit("")))), F.lit("CORRECT")), 1.0).otherwise(0.0)


def valid_anchor(content: Column, exact: Column, anchor: Column) -> Column:
    """An insertion is well formed: both given, no brackets, found in the line, not a repetition, with a digit."""

    def norm(c: Column) -> Column:
        return F.lower(collapse_space(c))

    return F.coalesce(
        (collapse_space(exact) != "")
        & (collapse_space(anchor) != "")
        & ~anchor.contains("(")
        & ~anchor.contains(")")
        & content.contains(exact)
        & (norm(exact) != norm(anchor))
        & anchor.rlike("[0-9]"),
        F.lit(False),
    )


def apply_anchor(content: Column, exact: Column, anchor: Column) -> Column:
    """`exact` becomes `exact (anchor)` if it occurs once and isn't followed by a bracket yet."""
    count = (F.length(content) - F.length(F.replace(content, exact, F.lit("")))) / F.length(exact)
    done = content.contains(F.concat(exact, F.lit(" (")))
    return F.when((count == 1) & ~done, F.replace(content, exact, F.concat(exact, F.lit(" ("), F.trim(anchor), F.lit(")")))).otherwise(content)


def apply_anchors(content: Column, insertions: Column) -> Column:
    """insertions: array of (exact, anchor). The valid ones are applied in turn, longest text (in bytes) first."""
    valid = F.filter(insertions, lambda x: valid_anchor(content, x["exact"], x["anchor"]))
    ordered = F.array_sort(valid, lambda a, b: F.octet_length(b["exact"]) - F.octet_length(a["exact"]))
    return F.aggregate(ordered, content, lambda text, x: apply_anchor(text, x["exact"], x["anchor"]))


def anchored_messages(messages: Column, insertions: Column) -> Column:
    """messages (seq, role, content, ts) with the insertions (line, exact, anchor) of each line applied to its collapsed content."""

    def line(m: Column, i: Column) -> Column:
        own = F.filter(insertions, lambda x: x["line"] == i)
        return F.struct(m["seq"].alias("seq"), m["role"].alias("role"), let(collapse_space(m["content"]), lambda c: apply_anchors(c, own)).alias("content"), m["ts"].alias("ts"))

    return F.transform(messages, line)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    out = template
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value, F.lit("")))
    return out


def title_or_default(title: Column) -> Column:
    return F.when(collapse_space(F.coalesce(title, F.lit(""))) == "", "Conversation Segment").otherwise(F.trim(title))


def shortened(text: Column, width: int = 80) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def narrow_duration(seconds: Column) -> Column:
    """1h 30m; seconds only when there is nothing else; 0s."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    parts = F.concat_ws(" ", F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))), F.when(m > 0, F.concat(m.cast("string"), F.lit("m"))))
    return F.when(parts != "", parts).otherwise(F.concat(F.pmod(s, F.lit(60)).cast("string"), F.lit("s")))


def human_age(seconds: Column) -> Column:
    """An age in words, by the largest whole unit."""
    out = F.lit("now")
    for size, name in ((1, "second"), (60, "minute"), (3600, "hour"), (86400, "day"), (7 * 86400, "week"), (30 * 86400, "month"), (365 * 86400, "year")):
        n = F.floor(seconds / size)
        out = F.when(seconds >= size, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))).otherwise(out)
    return out


def memories_markdown(contents: Column, facts: Column) -> Column:
    """Episodes as blocks, then facts as a list; nothing found is the empty text."""
    blocks = F.when(F.size(contents) > 0, F.concat(F.lit("## Episodic Memories\n"), F.array_join(F.transform(contents, lambda c: F.concat(c, F.lit("\n\n"))), ""))).otherwise("")
    known = F.when(F.size(facts) > 0, F.concat(F.lit("## Known Facts\n"), F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n"))).otherwise("")
    return F.regexp_replace(F.concat(blocks, known), r"\s+$", "")


def recent_entry(title: Column, surprise: Column, age: Column, content: Column) -> Column:
    """A recent memory as a section."""
    name = F.when(F.coalesce(title, F.lit("")) == "", "Memory").otherwise(title)
    mark = F.when(surprise >= KEY_MOMENT, " (key moment)").otherwise("")
    return F.concat(F.lit("### "), name, mark, F.lit("\n**When:** "), age, F.lit("\n**Content:** "), content, F.lit("\n"))


def percent(value: Column) -> Column:
    return F.format_string("%.2f%%", value * 100)


def signed_percent(value: Column) -> Column:
    return F.format_string("%+.2f%%", value * 100)


def event_text(role: Column, content: Column, ts: Column | None = None) -> Column:
    body = F.concat(role, F.lit(": "), content)
    return body if ts is None else F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), body)


def event_role(raw: Column) -> Column:
    """user and assistant in any case; any other role keeps its text."""
    return F.when(F.lower(raw).isin("user", "assistant"), F.lower(raw)).otherwise(raw)


def surprise_value(level: Column) -> Column:
    return F.when(level == "low", 0.2).when(level == "high", 0.6).when(level == "extremely_high", 0.9)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)
