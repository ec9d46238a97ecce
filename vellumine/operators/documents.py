"""Documents that people open: report pages, contact sheets, notes on habits, sidecars and stored recipes, as column expressions.

A page is put together from one row a section, whose cards are few; a whole run's pages are written section by section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.bound import once
from vellumine.operators import ranking

# Sections of a report in their order, with their colours.
SECTIONS = {"TOP": "#a978c4", "GOOD_STOCK": "#5fb98a", "GOOD_PERSONAL": "#6aa9d8", "NEEDS_DECISION": "#d8c06a", "WEAK": "#8a8a8a"}
HEAD = '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Report</title></head><body>'
TAIL = "</body></html>"


def escaped(text: Column) -> Column:
    """Text inside elements and double-quoted attributes; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def element(name: str, inner: Column, **attributes: Column) -> Column:
    """An element around markup; attributes are escaped here, `inner` is not."""
    own = [F.concat(F.lit(f' {k.rstrip("_")}="'), escaped(v), F.lit('"')) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *own, F.lit(">"), inner, F.lit(f"</{name}>"))


def items(texts: Column, name: str = "li") -> Column:
    return F.array_join(F.transform(texts, lambda t: element(name, escaped(t))), "")


def card(df: DataFrame, name: str = "card") -> DataFrame:
    """The rows with their card: picture, name, score, why, and what to do. Reads filename, category, final_score, reason, steps."""
    c = F.col
    colour = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SECTIONS.items() for x in pair)), c("category")), F.lit("#8a8a8a"))
    picture = F.concat(F.lit('<img src="'), escaped(c("filename")), F.lit('" alt="">'))
    steps = F.when(F.size("steps") > 0, element("ul", items(c("steps")))).otherwise("")
    body = F.concat(picture, element("h3", escaped(c("filename"))), element("b", c("final_score").cast("string")), element("p", escaped(c("reason"))), steps)
    return df.withColumn(name, element("div", body, class_=F.lit("card"), style=F.concat(F.lit("border-color:"), colour)))


def sections(cards: DataFrame, most: int = 200) -> DataFrame:
    """(category, page, n, html): cards in pages of `most`, best first; no section is cut short, further cards are on further pages."""
    paged = ranking.numbered_within(cards, "category", [F.desc("final_score"), F.col("filename")], "_p").withColumn("page", F.floor((F.col("_p") - 1) / most))
    whole = F.array_sort(F.collect_list(F.struct("_p", "card")))
    pages = paged.groupBy("category", "page").agg(F.count("*").alias("n"), F.array_join(F.transform(whole, lambda x: x["card"]), "").alias("_c"))
    return pages.select("category", "page", "n", F.concat(F.lit(HEAD), element("h2", escaped(F.col("category"))), F.col("_c"), F.lit(TAIL)).alias("html"))


def contact_sheet(df: DataFrame, columns: int = 5, most: int = 100) -> DataFrame:
    """(sheet, html): pictures in rows of a table, best first, `most` on a sheet; the last row is filled with empty cells. Reads position, filename, label."""
    cell = element("td", F.concat(F.lit('<img src="'), escaped(F.col("filename")), F.lit('" alt="">'), element("small", escaped(F.col("label")))))
    placed = df.select(F.floor(F.col("position") / most).alias("sheet"), F.floor(F.col("position") % most / columns).alias("row"), F.struct(F.col("position"), cell.alias("cell")).alias("x"))
    rows = placed.groupBy("sheet", "row").agg(F.array_sort(F.collect_list("x")).alias("cells"))
    filled = F.concat(F.transform("cells", lambda x: x["cell"]), F.array_repeat(F.lit("<td></td>"), columns - F.size("cells")))
    lines = rows.select("sheet", F.struct("row", element("tr", F.array_join(filled, "")).alias("line")).alias("y"))
    return lines.groupBy("sheet").agg(F.array_sort(F.collect_list("y")).alias("ys")).select("sheet", element("table", F.array_join(F.transform("ys", lambda y: y["line"]), "")).alias("html"))


def write_pages(pages: DataFrame, path: str, html: str = "html", names: list[str] | None = None) -> None:
    """Each page as a file in a folder of its section and number, written by Spark's committers; rows hold whole pages."""
    keys = names or ["category", "page"]
    pages.select(*keys, F.col(html).alias("value")).repartition(*keys).write.mode("overwrite").partitionBy(*keys).option("lineSep", "\n").text(path)


def improvements(records: DataFrame) -> DataFrame:
    """(advice, weight, evidence): up to three habits worth changing, the most frequent first.

    Reads best_in_cluster, portrait_verdict, read_completed, distinctiveness, moment, as_shot, final_score.
    """
    c = F.col
    one = records.agg(
        F.count("*").alias("total"), F.count_if(~c("best_in_cluster")).alias("twins"), F.count_if(c("portrait_verdict") == "reject").alias("faces"), F.count_if("read_completed").alias("read"),
        F.avg(F.when(c("read_completed"), c("distinctiveness"))).alias("distinct"), F.avg(F.when(c("read_completed"), c("moment"))).alias("moment"), F.count_if((c("as_shot") < 45) & (c("final_score") >= 60)).alias("dark"),
    )
    text = lambda pattern, *args: F.format_string(pattern, *args)
    whole = lambda x: F.bround(x).cast("long")
    rules = [
        (c("twins") > 0, "change_before_the_next_frame", c("twins"), text("%d of %d frames were near-duplicates of a better one", c("twins"), c("total"))), (c("faces") > 0, "shoot_through_the_moment", c("faces") * 3, text("%d portrait(s) lost to a blink or a mid-word expression", c("faces"))),
        ((c("read") > 0) & (c("distinct") <= 55), "move_before_the_obvious_view", c("read"), text("distinctiveness averages %d of 100 across the collection", whole(c("distinct")))), ((c("read") > 0) & (c("moment") <= 55), "wait_in_good_light", F.floor(c("read") * 0.9), text("moment specificity averages %d of 100", whole(c("moment")))),
        ((c("dark") >= 3) & (c("dark") / F.greatest(c("total"), F.lit(1)) >= 0.15), "expose_half_a_stop_more", c("dark"), text("%d frames scored under 45 as shot but 60+ after editing", c("dark"))),
    ]
    each = F.filter(F.array(*(F.when(rule, F.struct(F.lit(i).alias("i"), F.lit(advice).alias("advice"), weight.cast("long").alias("weight"), evidence.alias("evidence"))) for i, (rule, advice, weight, evidence) in enumerate(rules))), lambda x: x.isNotNull())
    return one.select(F.explode(each).alias("x")).select("x.*").orderBy(F.desc("weight"), "i").limit(3).drop("i")


# Namespaces and attributes of the darktable document, with the columns that they show.
DARKTABLE = [("variant", "variant"), ("intent", "intent"), ("sourceChecksum", "checksum"), ("exposureEV", "format_string('%+.2f', exposure_ev + 0.0D)"), ("highlights", "highlights"), ("shadows", "shadows"), ("contrast", "contrast"), ("blacks", "blacks"), ("whites", "whites"), ("temperatureDeltaK", "temperature"), ("denoise", "denoise"), ("sharpening", "sharpening"), ("monochrome", "variant = 'monochrome'")]


def darktable_document() -> Column:
    """A recipe's row as a sidecar that holds the suggestion and no history of the program's own."""
    shown = [F.concat(F.lit(f' v:{key}="'), escaped(F.expr(sql).cast("string")), F.lit('"')) for key, sql in DARKTABLE]
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:darktable="http://darktable.sf.net/" xmlns:v="urn:vellumine:recipe" darktable:import_timestamp="-1" darktable:history_end="0"'
    kept = element("v:preserve", element("rdf:Seq", items(F.col("preserve"), "rdf:li")))
    return F.concat(F.lit(head), *shown, F.lit(">"), kept, F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"))


def stock_sidecar() -> Column:
    """Title, description, keywords and place of a row as a metadata sidecar."""
    c = F.col
    alt = lambda name, text: element(name, element("rdf:Alt", F.concat(F.lit('<rdf:li xml:lang="x-default">'), escaped(text), F.lit("</rdf:li>"))))
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/">'
    body = F.concat(alt("dc:title", c("title")), alt("dc:description", c("description")), element("dc:subject", element("rdf:Bag", items(c("keywords"), "rdf:li"))), element("photoshop:Category", escaped(c("category"))), element("photoshop:City", escaped(c("location"))))
    return F.concat(F.lit(head), body, F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"))


RECIPE = "asset_id string, source_checksum string, variant string, intent string, exposure_ev double, highlights bigint, shadows bigint, contrast bigint, preserve array<string>, uses_generative boolean"


def recipe_text() -> Column:
    """A recipe's row as JSON, columns of RECIPE."""
    return F.to_json(F.struct(*(name.split()[0] for name in RECIPE.split(", "))))


def recipe_of(text: Column) -> Column:
    """A recipe from JSON; unknown fields are dropped, absent ones are null, and text that is no JSON gives nulls."""
    return F.from_json(text, RECIPE)


# The whole recipe document. Its fields with their kinds and what absent ones mean, by section.
_WHOLE = "contrast highlights shadows whites blacks temperature_delta_k tint_delta texture clarity dehaze vibrance saturation".split()
_TEXTS = ("array<string>", None)
DOCUMENT = {
    "": {"schema_version": ("int", 1), "asset_id": ("string", ""), "asset_key": ("string", ""), "source_checksum": ("string", ""), "variant": ("string", "faithful"), "intent": ("string", "")},
    "global": {"exposure_ev": ("double", 0.0)} | dict.fromkeys(_WHOLE, ("int", 0)),
    "geometry": {"rotation_deg": ("double", 0.0), "preserve_existing_tilt": ("boolean", False)},
    "crop": {"left": ("double", 0.0), "top": ("double", 0.0), "right": ("double", 1.0), "bottom": ("double", 1.0), "aspect_ratio": ("string", ""), "reason": ("string", ""), "confidence": ("double", 0.0)},
    "detail": dict.fromkeys(("denoise_luminance", "denoise_color", "sharpening", "masking"), ("int", 0)),
    "color": {"style": ("string", "neutral"), "monochrome": ("boolean", False), "hsl": ("array<map<string,string>>", None), "grading": ("array<map<string,string>>", None)},
    "confidence": dict.fromkeys(("tone", "color", "crop", "detail"), ("double", 0.0)),
    "last": {"preserve": _TEXTS, "warnings": _TEXTS, "evidence": _TEXTS, "engine": ("string", ""), "engine_version": ("string", ""), "uses_generative": ("boolean", False)},
}


def _kinds(section: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, (kind, _) in DOCUMENT[section].items())


_SECTIONS = ", ".join(f"{s}: struct<{_kinds(s)}>" for s in ("global", "detail", "color", "confidence"))
DOCUMENT_KIND = f"struct<{_kinds('')}, {_SECTIONS}, geometry: struct<{_kinds('geometry')}, crop: struct<{_kinds('crop')}>>, {_kinds('last')}>"


def _filled(of: Column, section: str) -> list[Column]:
    default = lambda kind, value: F.array().cast(kind) if value is None else F.lit(value).cast(kind)
    return [F.coalesce(of[name], default(kind, value)).alias(name) for name, (kind, value) in DOCUMENT[section].items()]


def document_of(text: Column) -> Column:
    """The whole recipe of a JSON document, parsed once: unknown fields are dropped, absent ones have their defaults, an absent crop is null; null for what is no JSON object."""

    def whole(raw: Column) -> Column:
        crop = F.when(raw["geometry"]["crop"].isNotNull(), F.struct(*_filled(raw["geometry"]["crop"], "crop")))
        sections = [F.struct(*_filled(raw[s], s)).alias(s) for s in ("global", "detail", "color", "confidence")]
        return F.when(raw.isNotNull(), F.struct(*_filled(raw, ""), *sections, F.struct(*_filled(raw["geometry"], "geometry"), crop.alias("crop")).alias("geometry"), *_filled(raw, "last")))

    read = lambda t: once(F.from_json(t, DOCUMENT_KIND, {"columnNameOfCorruptRecord": ""}), whole)
    return once(text, lambda t: F.when(F.startswith(F.ltrim(t), F.lit("{")), read(t)))


def document_text(recipe: Column) -> Column:
    """A whole recipe as its JSON document, with the share that its crop keeps."""

    def written(r: Column) -> Column:
        crop = r["geometry"]["crop"]
        keeps = F.bround(F.greatest(F.lit(0.0), crop["right"] - crop["left"]) * F.greatest(F.lit(0.0), crop["bottom"] - crop["top"]), 4)
        geometry = r["geometry"].withField("crop", F.when(crop.isNotNull(), crop.withField("keeps", keeps)))
        return F.to_json(r.withField("geometry", geometry), {"ignoreNullFields": "false"})

    return once(recipe, written)


# Facts of a file's tags.


def first_tag(tags: Column, *names: str) -> Column:
    """The first of some tags that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(tags, F.lit(n))), F.lit("")) for n in names))


def shutter(text: Column) -> Column:
    """An exposure time ('1/250', '0.004', '2') as people write it: a fraction below a second, else seconds; null for junk and none."""
    from vellumine.functions.numbers import parse_ratio

    top, bottom = F.split(text, "/")[0].try_cast("double"), F.when(F.instr(text, "/") > 0, F.try_element_at(F.split(text, "/"), F.lit(2)).try_cast("double")).otherwise(F.lit(1.0))
    seconds = F.coalesce(F.try_divide(top, bottom), parse_ratio(text))
    return F.when(seconds <= 0, F.lit(None).cast("string")).when(seconds < 1, F.concat(F.lit("1/"), F.bround(1 / seconds).cast("long").cast("string"))).otherwise(F.concat(F.format_string("%.1f", F.bround(seconds, 1)), F.lit("s")))


def shot_at(text: Column) -> Column:
    """A date of one of three forms as ISO text; null otherwise."""
    parsed = F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(form)) for form in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")))
    return F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss")


def exif_facts(df: DataFrame, tags: str = "tags") -> DataFrame:
    """The rows with make, model, lens, iso, aperture, focal_length, shutter and shot of a map of tags; what isn't there or can't be read is null."""
    t = F.col(tags)
    ratio = lambda x: F.bround(F.try_divide(F.split(x, "/")[0].try_cast("double"), F.coalesce(F.try_element_at(F.split(x, "/"), F.lit(2)).try_cast("double"), F.lit(1.0))), 4)
    return df.withColumns({
        "make": first_tag(t, "Make"), "model": first_tag(t, "Model"), "lens": first_tag(t, "LensModel", "LensSpecification"), "iso": first_tag(t, "ISOSpeedRatings").try_cast("double").cast("long"), "aperture": ratio(first_tag(t, "FNumber")), "focal_length": ratio(first_tag(t, "FocalLength")),
        "shutter": shutter(first_tag(t, "ExposureTime")), "shot": shot_at(first_tag(t, "DateTimeOriginal", "DateTime")),
    })
