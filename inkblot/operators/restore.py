"""Restoring originals from placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkblot.functions.arrays import index_pass, let

PLACEHOLDER = r"<[^<>]+_[0-9]+>"


def has_placeholder_text(text: Column) -> Column:
    """Whether a text holds something that reads like a placeholder before any scrubbing."""
    return text.rlike(PLACEHOLDER)


def restore_text(text: Column, originals: Column) -> Column:
    """A text with the entries of its ``map<placeholder, original>`` put back.

    As if done longest placeholder first, one after the other, each wherever it occurs. Where no original
    can be part of a placeholder the order does not matter, and the text is cut once at its placeholders.
    """

    def filled(entries: Column) -> Column:
        plain = F.forall(entries, lambda e: e["key"].rlike(f"^{PLACEHOLDER}\\z") & ~F.contains(e["value"], F.lit("<")) & ~F.contains(e["value"], F.lit(">")))
        found = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
        put_back = F.when(plain, let(found, lambda found: _looked_up(text, found, entries))).otherwise(_one_by_one(text, entries))
        return F.when(F.size(entries) == 0, text).otherwise(put_back)

    return let(F.map_entries(originals), filled)


def _one_by_one(text: Column, entries: Column) -> Column:
    by_length = F.reverse(
        F.sort_array(
            F.transform(entries, lambda e, i: F.struct(F.length(e["key"]).alias("n"), (-i).alias("i"), e["key"].alias("k"), e["value"].alias("v")))
        )
    )
    return F.aggregate(by_length, text, lambda t, e: F.replace(t, e["k"], e["v"]))


_ASKED = "struct<key:string,pos:int,value:string>"


def _looked_up(text: Column, found: Column, entries: Column) -> Column:
    """Placeholders and entries sorted together: each placeholder follows the entry of its name."""
    known = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.lit(-1).alias("pos"), e["value"].alias("value")))
    asked = F.transform(found, lambda k, i: F.struct(k.alias("key"), i.alias("pos"), F.lit(None).cast("string").alias("value")))
    together = F.sort_array(F.concat(known.cast(f"array<{_ASKED}>"), asked.cast(f"array<{_ASKED}>")))

    def answered(together: Column) -> Column:
        # the entry before each placeholder, by its index; only numbers are carried
        def step(entry: Column, i: Column) -> tuple[Column, Column, None]:
            after = F.when(F.get(together, i)["pos"] < 0, i).otherwise(entry)
            return after, after, None

        def one(x: Column, entry: Column) -> Column:
            known = F.get(together, entry)
            value = F.when(known["key"] == x["key"], known["value"])
            return F.struct(x["pos"].alias("pos"), F.coalesce(value, x["key"]).alias("value"))

        entries = index_pass(F.size(together), F.lit(-1), step)
        return F.filter(F.zip_with(together, entries, one), lambda a: a["pos"] >= 0)

    answers = F.sort_array(let(together, answered))
    return F.when(F.size(found) > 0, let(answers, lambda values: _filled(F.split(text, PLACEHOLDER, -1), values))).otherwise(text)


def _filled(gaps: Column, answers: Column) -> Column:
    def joined(gaps: Column) -> Column:
        pieces = F.transform(answers, lambda a, i: F.concat(F.get(gaps, i), a["value"]))
        return F.array_join(F.concat(pieces, F.array(F.element_at(gaps, -1))), "")

    return let(gaps, joined)


def vault_conflicts(vault: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Placeholders for which a vault holds several originals: ``id, placeholder, n``."""
    return vault.groupBy(id_col, "placeholder").agg(F.count_distinct("original").alias("n")).where("n > 1")


def restore(scrubbed: DataFrame, vault: DataFrame, id_col: str = "doc_id", text_col: str = "text", open_col: str | None = None) -> DataFrame:
    """Scrubbed texts with the originals of ``vault(id, placeholder, original)`` put back.

    Only placeholders that stand in a text are looked up, by document and placeholder, so that a
    document with very many of them does not gather in one task. All are replaced in one pass over
    the text: an original that itself reads like a placeholder is left as it was. A vault may hold a row
    more than once; of several originals for one placeholder (:func:`vault_conflicts`) the least is taken.
    ``open_col`` names a column that says whether a placeholder of the text is not in the vault.
    """
    text = F.col(text_col)
    marked = scrubbed.withColumn("_found", F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)))
    # No row without an id has an answer. Rows are dealt by document and placeholder before they are gathered: what
    # a task sorts and hashes is then its share of a shuffle, which Spark sizes, and not all that its split holds.
    has_id = F.col(id_col).isNotNull()
    wanted = marked.where(has_id).select(id_col, F.posexplode_outer("_found").alias("_pos", "placeholder")).where("placeholder is not null")
    wanted = wanted.repartition(id_col, "placeholder")
    known = vault.where(has_id).repartition(id_col, "placeholder").groupBy(id_col, "placeholder").agg(F.min("original").alias("original"))
    answers = (
        wanted.distinct().join(known, [id_col, "placeholder"], "left")
        .groupBy(id_col)
        # as many as the text has placeholders; a text that stands in the table twice has them once
        .agg(F.sort_array(F.collect_set(F.struct(F.col("_pos").alias("pos"), "placeholder", "original"))).alias("_answers"))
    )
    # rows of one id may hold different texts: an answer counts where its placeholder stands at its place
    own = F.filter("_answers", lambda a: F.get(F.col("_found"), a["pos"]) == a["placeholder"])
    values = F.transform(own, lambda a: F.struct(a["pos"].alias("pos"), F.coalesce(a["original"], a["placeholder"]).alias("value")))
    restored = F.when(F.size("_found") > 0, let(values, lambda v: _filled(F.split(text, PLACEHOLDER, -1), v))).otherwise(text)
    joined = marked.join(answers, id_col, "left")
    if open_col:
        # an id that is null has no answers
        known_all = F.when(F.col("_answers").isNotNull(), ~F.exists(own, lambda a: a["original"].isNull())).otherwise(F.size("_found") <= 0)
        joined = joined.withColumn(open_col, ~known_all & F.col(text_col).isNotNull())
    return joined.withColumn(text_col, restored).drop("_found", "_answers")
