"""Writers: records, flat tables, submission lists, sidecar texts, append-only logs. Folders are written by Spark's committers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stars by pile.
STARS = {"TOP": 5, "GOOD_STOCK": 4, "GOOD_PERSONAL": 4, "NEEDS_DECISION": 3, "WEAK": 2}


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays as texts joined by '; ', structs as columns of their own."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            out.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), "; ").alias(f.name))
        elif kind == "struct":
            out.extend(F.col(f"{f.name}.{s.name}").alias(f"{f.name}_{s.name}") for s in f.dataType.fields)
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", "true").csv(path)


def by_section(df: DataFrame, path: str, section: str = "category") -> None:
    """A folder for each section."""
    df.write.mode("overwrite").partitionBy(section).parquet(path)


def rating_sidecar(category: Column) -> Column:
    """The text of a rating sidecar."""
    stars = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in STARS.items() for x in kv)), category), F.lit(0))
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:Rating="'
    return F.concat(F.lit(head), stars.cast("string"), F.lit('" xmp:Label="'), category, F.lit('"/></rdf:RDF></x:xmpmeta>'))


# Labels by pile, and the namespace that ratings are in.
LABELS = {"TOP": "Yellow", "GOOD_STOCK": "Green", "GOOD_PERSONAL": "Blue", "NEEDS_DECISION": "Purple", "WEAK": "Red"}
XMP = 'xmlns:xmp="http://ns.adobe.com/xap/1.0/"'


def with_attribute(document: Column, key: str, value: Column) -> Column:
    """A document whose first attribute of a key has the value; without one, its first description gets it, and the namespace if that isn't declared."""
    value = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    attribute = F.concat(F.lit(f'{key}="'), value, F.lit('"'))
    # Anchored at the start, a pattern meets its first place alone; a text between quotes has neither backslash nor dollar sign after this.
    put = F.regexp_replace(attribute, r"([\\\\$])", r"\\\\$1")
    there = rf'\A([\s\S]*?){key}\s*=\s*"[^"]*"'
    declared = F.when(F.contains(document, F.lit("xmlns:xmp=")), F.lit("")).otherwise(F.lit(XMP + " "))
    inserted = F.regexp_replace(document, F.lit(r"\A([\s\S]*?<rdf:Description)(?=[\s/>])"), F.concat(F.lit("$1 "), declared, put))
    return F.when(document.rlike(there), F.regexp_replace(document, F.lit(there), F.concat(F.lit("$1"), put))).otherwise(inserted)


def merged_rating(existing: Column, category: Column) -> Column:
    """An existing sidecar with a pile's stars and label in place of its first ones, or in its first description; all else stays."""
    of = lambda table, other: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.upper(F.coalesce(category, F.lit("")))), F.lit(other))
    return with_attribute(with_attribute(existing, "xmp:Rating", of(STARS, 0).cast("string")), "xmp:Label", of(LABELS, ""))


def plan_ratings(records: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(key, exists, document): what each record's sidecar would hold, from (key, category) and the existing (key, document)."""
    j = records.join(sidecars.select("key", F.col("document").alias("_d")), "key", "left")
    return j.select("key", F.col("_d").isNotNull().alias("exists"), F.when(F.col("_d").isNull(), rating_sidecar(F.col("category"))).otherwise(merged_rating(F.col("_d"), F.col("category"))).alias("document"))


def write_texts(df: DataFrame, path: str, text: str) -> None:
    df.select(F.col(text).cast("string").alias("value")).write.mode("overwrite").text(path)
