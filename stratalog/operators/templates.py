"""Template mining with the Drain algorithm (He et al., ICWS 2017), and matching with built-in functions.

Drain's tree parts messages by their number of tokens first, then by leading tokens; clusters of different branches never
meet. So each (length, first token) branch is fitted on its own, over its distinct messages in order of first occurrence.

A branch that very many messages share is no one task's: its messages are fitted in parts by the upper bits of their order,
which for lines as read_lines numbers them are the splits of the input, and the parts' templates are fitted again in the same
way. Wildcards are no equal tokens, so templates that the parts keep apart stay apart, and those that say the same become one.
Orders below 2^33, such as line numbers, are one part.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WILD = "<*>"
#: Depth counts the root, the length and the clusters, so that with 4 one leading token is routed by.
DEPTH, SIMILARITY, CHILDREN = 4, 0.4, 100
#: Leading tokens by which match() looks for templates.
LEADING = 3


def tokens(message: Column) -> Column:
    return F.filter(F.split(F.trim(message), r"\s+"), lambda t: t != "")


def _digits(token: str) -> bool:
    return any(c.isdigit() for c in token)


def fit_branch(messages: list[list[str]], known: list[list[str]] = (), depth: int = DEPTH, similarity: float = SIMILARITY, children: int = CHILDREN) -> list[list[str]]:
    """The templates of one branch's token lists, in order; known templates of earlier runs come first."""
    tree: dict = {}
    clusters = [list(k) for k in known]

    def leaf(words: list[str]) -> list[int]:
        node = tree
        for w in words[: max(1, depth - 3)]:
            w = WILD if _digits(w) else w
            if w not in node:
                if WILD in node and len(node) >= children:
                    w = WILD
                elif len(node) + 1 >= children:
                    w = WILD
            node = node.setdefault(w, {})
        return node.setdefault(None, [])

    for i, c in enumerate(clusters):
        leaf(c).append(i)
    for words in messages:
        own = leaf(words)
        best, best_key = None, (-1.0, -1)
        for i in own:
            same = sum(a == b != WILD for a, b in zip(clusters[i], words))
            wild = sum(t == WILD for t in clusters[i])
            key = (same / max(1, len(words)), wild)
            if key > best_key:
                best, best_key = i, key
        if best is not None and best_key[0] >= similarity:
            clusters[best] = [a if a == b else WILD for a, b in zip(clusters[best], words)]
        else:
            own.append(len(clusters))
            clusters.append(list(words))
    return clusters


def first_places(messages: list[list[str]], places: list[int], found: list[list[str]]) -> list[int]:
    """For each template the place of the first message that it fits; -1 without one."""
    out, open_ones = [-1] * len(found), set(range(len(found)))
    for words, at in zip(messages, places, strict=True):
        if not open_ones:
            break
        for i in sorted(open_ones):
            if all(t in (WILD, w) for t, w in zip(found[i], words)):
                out[i] = at
                open_ones.discard(i)
    return out


def fit(events: DataFrame, message: str = "message_clean", order: str = "ord", known: DataFrame | None = None) -> DataFrame:
    """(template_id, template_str, n_tokens): templates in order of their first message. known: templates of earlier runs, whose ids stay."""
    lead = lambda words: F.when(F.get(words, F.lit(0)).rlike(r"\d"), WILD).otherwise(F.get(words, F.lit(0))).alias("lead")
    first = events.where(F.trim(F.coalesce(message, F.lit(""))) != "").groupBy(F.col(message).alias("m")).agg(F.min(order).alias("at"))
    first = first.withColumn("words", tokens(F.col("m"))).select(F.size("words").alias("n"), lead(F.col("words")), "words", "at", F.lit(None).cast("long").alias("id"))

    def branch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"])
        old, new = pdf[pdf.id.notna()], pdf[pdf.id.isna()]
        found = fit_branch([list(w) for w in new.words], [list(w) for w in old.words])
        # The first message of a template is the first that its leaf took; later ones may have made it wider.
        firsts = first_places([list(w) for w in new.words], new["at"].tolist(), found)
        ids = [*old.id.tolist(), *[None] * (len(found) - len(old))]
        rows = [(None if i is None else int(i), c, len(c), int(firsts[k]), str(pdf["lead"].iloc[0])) for k, (i, c) in enumerate(zip(ids, found))]
        return pd.DataFrame(rows, columns=["id", "words", "n", "at", "lead"]).astype({"id": "Int64"})

    kind = "id long, words array<string>, n int, at long, lead string"
    parts = first.withColumn("part", F.shiftright("at", 33)).groupBy("n", "lead", "part").applyInPandas(branch, kind)
    if known is not None:
        words = F.split("template_str", " ")
        parts = parts.unionByName(known.select(F.col("template_id").alias("id"), words.alias("words"), F.size(words).alias("n"), F.lit(-1).cast("long").alias("at"), lead(words)))
    found = parts.groupBy("n", "lead").applyInPandas(branch, kind).groupBy(F.array_join("words", " ").alias("template_str"), F.col("n").alias("n_tokens")).agg(F.min("id").alias("id"), F.min("at").alias("at"))
    top = F.coalesce(F.max("id").over(Window.partitionBy()), F.lit(0))
    fresh = F.row_number().over(Window.partitionBy(F.col("id").isNull()).orderBy("at", "template_str"))
    return found.withColumn("top", top).withColumn("template_id", F.coalesce("id", F.col("top") + fresh)).select("template_id", "template_str", "n_tokens")


def match(events: DataFrame, templates: DataFrame, message: str = "message_clean") -> DataFrame:
    """events with template_id, template_str and params {var1, ...} of the most special template that fits; nulls for empty messages.

    The join is by number of tokens and a leading token, on distinct messages; Spark broadcasts the templates only if they are small.
    """
    words = tokens(F.col("m"))
    distinct = events.select(F.col(message).alias("m")).where(F.trim(F.coalesce("m", F.lit(""))) != "").distinct().withColumn("words", words).withColumn("n_tokens", F.size("words"))
    parts = F.split("template_str", " ")
    # Templates are found by their first literal among the leading tokens; only those without one meet all messages of a length.
    literal = [F.when(F.get("parts", F.lit(i)) != WILD, F.struct(F.lit(i).alias("p"), F.get("parts", F.lit(i)).alias("t"))) for i in range(LEADING)]
    nothing = F.struct(F.lit(-1).alias("p"), F.lit("").alias("t"))
    own = templates.withColumn("parts", parts).withColumn("anchor", F.coalesce(*literal, nothing))
    asked = F.array(*(F.struct(F.lit(i).alias("p"), F.coalesce(F.get("words", F.lit(i)), F.lit("")).alias("t")) for i in range(LEADING)), nothing)
    fits = distinct.withColumn("anchor", F.explode(asked)).join(own, ["n_tokens", "anchor"]).where(F.forall(F.zip_with("parts", "words", lambda t, w: (t == WILD) | (t == w)), lambda x: x))
    wild = F.size(F.filter("parts", lambda t: t == WILD))
    best = fits.groupBy("m").agg(F.min_by(F.struct("template_id", "template_str", "parts", "words"), F.struct(wild, "template_id")).alias("b"))
    values = F.transform(F.filter(F.arrays_zip(F.col("b.parts").alias("t"), F.col("b.words").alias("w")), lambda x: x["t"] == WILD), lambda x: x["w"])
    named = best.select("m", "b.template_id", "b.template_str", F.map_from_entries(F.transform(values, lambda v, i: F.struct(F.concat(F.lit("var"), (i + 1).cast("string")), v))).alias("params"))
    return events.join(named, events[message] == named["m"], "left").drop("m").withColumn("params", F.coalesce("params", F.create_map().cast("map<string,string>")))


def template_count(templates: DataFrame) -> DataFrame:
    return templates.agg(F.count(F.lit(1)).alias("templates"))
