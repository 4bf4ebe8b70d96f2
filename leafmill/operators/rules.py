"""Constraints as named boolean columns, and the report of rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids


def violations(df: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """One row for each broken rule of each row; a rule that is null counts as broken."""
    checks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(*keys, F.explode(F.array_compact(checks)).alias("rule"))


def page_rules(observations: DataFrame, doc: str) -> DataFrame:
    """Observations of a page that break its order: repeated order or id, or a parent that doesn't come earlier."""
    page = Window.partitionBy(doc, "page")
    counted = observations.withColumns({
        "same_order": F.count("*").over(page.partitionBy(doc, "page", "reading_order")),
        "same_id": F.count("*").over(page.partitionBy(doc, "page", "observation_id")),
    })
    parents = observations.select(doc, "page", F.col("observation_id").alias("parent_observation_id"), F.col("reading_order").alias("parent_order")).groupBy(doc, "page", "parent_observation_id").agg(F.min("parent_order").alias("parent_order"))
    joined = counted.join(parents, [doc, "page", "parent_observation_id"], "left")
    rules = {
        "unique_order": F.col("same_order") == 1, "unique_id": F.col("same_id") == 1,
        "parent_earlier": F.col("parent_observation_id").isNull() | (F.coalesce("parent_order", F.lit(1 << 30)) < F.col("reading_order")),
        "text_bytes": F.octet_length("text") <= 65_536, "text_not_blank": F.col("text").rlike(r"(?U)\S"),
    }
    return violations(joined, rules, doc, "page", "observation_id")


def upload_rules() -> dict[str, Column]:
    """Lifecycle shapes of an upload: what its status says must or mustn't be there."""
    has = lambda c: F.col(c).isNotNull()
    done = F.col("status").isin("accepted", "inspecting", "uploaded", "rejected")
    return {
        "verification": ~done | (has("verified_digest") & has("verified_length")),
        "accepted_source": (F.col("status") == "accepted") == has("source_name"),
        "lease": (F.col("status") == "inspecting") == (has("lease_owner") & has("lease_expires_at")),
        "rejection": (F.col("status") == "rejected") == has("rejection_reason"),
        "parser": (F.col("status") != "accepted") | (has("page_count") & F.col("page_count").between(1, 1000)),
    }


def outbox_rules() -> dict[str, Column]:
    """Delivery shapes: published and dead rows hold no lease, dead rows have used all attempts, a lease has owner and end."""
    idle = F.col("lease_owner").isNull() & F.col("lease_expires_at").isNull()
    return {
        "published": F.col("published_at").isNull() | (idle & F.col("dead_lettered_at").isNull()),
        "dead": F.col("dead_lettered_at").isNull() | (idle & (F.col("delivery_attempts") == 20)),
        "lease": F.col("lease_owner").isNull() == F.col("lease_expires_at").isNull(),
        "attempts": F.col("delivery_attempts").between(0, 20),
    }


def geometry_rules() -> dict[str, Column]:
    """Consistency of an accepted upload's page geometries (array ``geometries`` of page, width, height)."""
    g = F.col("geometries")
    pixels = F.transform(g, lambda p: p["width"].cast("long") * p["height"])
    return {
        "count": F.size(g) == F.col("page_count"),
        "numbered": F.forall(F.transform(g, lambda p, i: p["page"] == i + 1), lambda ok: ok),
        "largest": F.array_max(pixels) == F.col("max_pixels"),
        "total": F.aggregate(pixels, F.lit(0).cast("long"), lambda a, x: a + x) == F.col("total_pixels"),
    }


def request_rules(document_types: list[str], classes: list[str], schemas: list[tuple[str, str]]) -> dict[str, Column]:
    """Bounds of a job request."""
    hints = F.col("language_hints")
    known = F.lit(False)
    for name, version in schemas:
        known = known | ((F.col("schema_id") == name) & (F.col("schema_version") == version))
    return {
        "document_type": F.col("document_type").isin(document_types), "processing_class": F.col("processing_class").isin(classes),
        "hints": (F.size(hints) <= 8) & (F.size(F.array_distinct(hints)) == F.size(hints)) & F.forall(hints, lambda h: h.rlike(ids.PATTERNS["language"])),
        "schema": F.col("schema_id").isNull() | known,
    }


def tensor_rules() -> dict[str, Column]:
    """Envelope of a model's tensors (arrays ``inputs`` and ``outputs`` of name, shape, bytes_per_element)."""
    both = F.concat("inputs", "outputs")
    size = F.transform(both, lambda t: F.aggregate(t["shape"], t["bytes_per_element"].cast("long"), lambda a, d: a * d))
    names = lambda c: F.transform(c, lambda t: t["name"])
    return {
        "count": F.size(both).between(1, 16), "rank": F.forall(both, lambda t: F.size(t["shape"]).between(1, 8)),
        "bytes": F.aggregate(size, F.lit(0).cast("long"), lambda a, x: a + x) <= 128 << 20,
        "unique": (F.size(F.array_distinct(names("inputs"))) == F.size("inputs")) & (F.size(F.array_distinct(names("outputs"))) == F.size("outputs")),
        "disjoint": ~F.arrays_overlap(names("inputs"), names("outputs")),
    }


def coverage(df: DataFrame, key: str, index: str, count: str) -> DataFrame:
    """Whether each batch's outputs are exactly 0 to n - 1."""
    got = df.groupBy(key).agg(F.count("*").alias("outputs"), F.countDistinct(index).alias("different"), F.min(index).alias("low"), F.max(index).alias("high"), F.first(count).alias("n"))
    return got.select(key, ((F.col("outputs") == F.col("n")) & (F.col("different") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("covered"))


def usable_lines(lines: DataFrame, doc: str) -> DataFrame:
    """Lines of pages on which no line is unusable, numbered anew; one bad line empties its whole page."""
    from ..functions.text import unusable

    bad = lines.where(unusable(F.col("text"))).select(doc, "page").distinct()
    order = Window.partitionBy(doc, "page").orderBy("reading_order")
    return lines.join(bad, [doc, "page"], "left_anti").withColumn("line", F.row_number().over(order) - 1)
