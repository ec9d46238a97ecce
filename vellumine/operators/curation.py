"""One final score from the components that exist, floors before ceilings, and five piles.

Beside the score dimensions it reads the content read (present, genre, axes, subject_strength, intended,
accidental, dead_moment) and the artistic read `art`, a struct or null: usable, candidate boolean; confidence,
uncertainty and the eight dimensions as longs; says_deliberate boolean; face, a struct or null: applies boolean,
area double, eyes_shut, bad_expression boolean; quality, publishability, pose, sharpness, confidence, blink, grimace long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine import params
from vellumine.functions.numbers import clamp_score

# How far each defect lets a score come, worst first.
CEILINGS = {"accidental_frame": 22, "no_subject": 28, "unrecoverable": 30, "eyes_closed": 32, "bad_expression": 34, "dead_moment": 38}
VETOABLE = ["accidental_frame", "no_subject", "dead_moment"]
CERTAIN, WEAK_SUBJECT, NO_READ_CEILING = 65, 25, 79
STRONG_DIMENSION, UPLIFT_CONFIDENCE, DOCUMENTARY_FLOOR, ARTISTIC_FLOOR = 78, 65, 55, 58
TOP, WEAK, TOP_CONFIDENCE, TOP_FLOOR, UNSURE, BAND = 85, 45, 60, 62, 70, 6
# What a face must reach before its frame is promoted.
FACE = {"area": 0.04, "confidence": 60, "quality": 70, "sharpness": 65, "blink": 40, "grimace": 40, "art_confidence": 55, "unusable_quality": 45, "unusable_publishability": 50}


def _art(name: str) -> Column:
    return F.col("art")[name]


def _face(name: str) -> Column:
    return F.col("art")["face"][name]


def usable() -> Column:
    return F.coalesce(_art("usable"), F.lit(False))


def is_portrait() -> Column:
    return F.col("present") & (F.lower("genre") == "portrait")


def face_gates() -> Column:
    """Whether a face decides about the frame: in portraits always, elsewhere from a share of the area on."""
    return F.coalesce(_face("applies") & (is_portrait() | (_face("area") >= FACE["area"])), F.lit(False))


def _unusable_face() -> Column:
    return (_face("quality") <= FACE["unusable_quality"]) & (_face("publishability") <= FACE["unusable_publishability"])


def portrait_verdict() -> Column:
    """reject, review or keep."""
    sure = _face("confidence") >= FACE["confidence"]
    return F.when(face_gates() & sure & (_face("eyes_shut") | _unusable_face()), "reject").when(face_gates() & ~sure & _face("bad_expression"), "review").otherwise("keep")


def hero_blocked() -> Column:
    """Whether a fact of the read forbids promotion; a missing read does."""
    sure = _face("confidence") >= FACE["confidence"]
    deliberate = F.coalesce(_art("says_deliberate"), F.lit(False))
    face = (
        ~sure | (_face("eyes_shut") & ~deliberate) | (_face("bad_expression") & sure) | (_unusable_face() & sure) | (_face("quality") < FACE["quality"])
        | ((_face("sharpness") < FACE["sharpness"]) & ~deliberate) | (_face("blink") > FACE["blink"]) | (_face("grimace") > FACE["grimace"])
    )
    return ~usable() | F.coalesce(_art("confidence") < FACE["art_confidence"], F.lit(True)) | F.coalesce(face_gates() & face, F.lit(False))


def uplifts() -> tuple[Column, Column]:
    """Whether the documentary and the artistic floor are earned."""
    sure = usable() & (_art("confidence") >= UPLIFT_CONFIDENCE)
    yes = lambda x: F.coalesce(x, F.lit(False))
    return yes(sure & (_art("documentary_significance") >= STRONG_DIMENSION)), yes(sure & _art("candidate") & (_art("distinctiveness") >= STRONG_DIMENSION))


def defects() -> dict[str, Column]:
    """By code, whether the defect is there; worst ceiling first."""
    c = F.col
    bad = usable() & (portrait_verdict() == "reject") & ~F.coalesce(_art("says_deliberate"), F.lit(False))
    return {
        "accidental_frame": c("present") & (~c("intended") | (c("accidental") >= CERTAIN)), "no_subject": c("present") & (c("subject_strength") <= WEAK_SUBJECT), "unrecoverable": c("n_unrecoverable") > 0,
        "eyes_closed": F.coalesce(bad & _face("eyes_shut"), F.lit(False)), "bad_expression": F.coalesce(bad & ~_face("eyes_shut"), F.lit(False)), "dead_moment": c("present") & (c("dead_moment") >= CERTAIN),
    }


def blend(components: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the components that aren't null, their weights scaled up; 0 if none is there."""
    top, total = F.lit(0.0), F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.when(components[name].isNotNull(), weight).otherwise(0.0)
    for name, weight in weights.items():
        top = top + F.when(components[name].isNotNull(), F.try_divide(F.lit(weight), total) * components[name]).otherwise(0.0)
    return F.when(total > 0, clamp_score(top)).otherwise(0).cast("long")


def components(with_read: bool) -> dict[str, Column]:
    c = F.col
    semantic = clamp_score(0.70 * (0.40 * c("axis_b") + 0.30 * c("axis_c") + 0.30 * c("axis_a")) + 0.30 * c("subject_strength"))
    out = {"technical": c("post_edit_potential"), "semantic": F.when(c("present"), semantic), "documentary": F.when(c("present"), c("axis_c")).otherwise(50)}
    if not with_read:
        return out
    art = F.lit(0.0)
    for name, weight in params.ARTISTIC.items():
        art = art + weight * _art(name)
    face = clamp_score(0.40 * _face("publishability") + 0.30 * _face("quality") + 0.15 * _face("pose") + 0.15 * _face("sharpness"))
    return out | {"artistic": clamp_score(art), "portrait": F.when(face_gates(), face), "documentary": _art("documentary_significance")}


def final_score(df: DataFrame) -> DataFrame:
    """The rows with blended, final_score, without_read, read_delta, worst_defect (null for none), vetoed boolean."""
    found = defects()
    documentary, artistic = uplifts()
    floor = F.greatest(F.when(documentary, DOCUMENTARY_FLOOR).otherwise(0), F.when(artistic, ARTISTIC_FLOOR).otherwise(0))
    overruled = documentary | artistic
    live = {k: v & (~overruled if k in VETOABLE else F.lit(True)) for k, v in found.items()}
    ceiling = lambda named, extra: F.least(*(F.when(x, CEILINGS[k]).otherwise(100) for k, x in named.items()), extra)
    df = df.withColumns({"_with": blend(components(True), params.BLEND_WITH_READ), "_without": blend(components(False), params.BLEND_WITHOUT)})
    plain = {k: found[k] for k in ("accidental_frame", "no_subject", "unrecoverable", "dead_moment")}
    without = F.least(F.col("_without"), ceiling(plain, F.lit(NO_READ_CEILING))).cast("long")
    value = F.when(usable(), F.least(F.greatest(F.col("_with"), floor), ceiling(live, F.lit(100)))).otherwise(without).cast("long")
    worst = F.lit(None).cast("string")
    for name in reversed(CEILINGS):
        worst = F.when(live[name], name).otherwise(worst)
    vetoed = overruled & (found["accidental_frame"] | found["no_subject"] | found["dead_moment"])
    df = df.withColumns({"blended": F.when(usable(), F.col("_with")).otherwise(F.col("_without")), "final_score": value, "without_read": without, "worst_defect": worst, "vetoed": vetoed})
    return df.withColumn("read_delta", F.col("final_score") - F.col("without_read")).drop("_with", "_without")


def categorise(df: DataFrame, profile: params.Profile = params.PROFILES["default-photo"]) -> DataFrame:
    """The rows of `final_score` with `category`, one of five piles."""
    c = F.col
    art = F.lit(0.0)
    for name, weight in params.ARTISTIC.items():
        art = art + weight * _art(name)
    clears = F.coalesce(usable() & (_art("confidence") >= TOP_CONFIDENCE) & ~hero_blocked() & (clamp_score(art) >= TOP_FLOOR), F.lit(False))
    unsure = F.coalesce(usable() & (F.abs(c("final_score") - WEAK) <= BAND) & ((_art("uncertainty") >= UNSURE) | (portrait_verdict() == "review")), F.lit(False))
    sells = c("present") & (c("stock_potential") >= profile.limits["stock_standard"])
    pile = F.when(c("worst_defect").isNotNull(), "WEAK").when((c("final_score") >= TOP) & clears, "TOP").when(c("final_score") < WEAK, "WEAK").when(unsure, "NEEDS_DECISION").when(sells, "GOOD_STOCK").otherwise("GOOD_PERSONAL")
    return df.withColumn("category", pile)


def counts(df: DataFrame, column: str = "category", values: list[str] = params.CATEGORIES) -> DataFrame:
    """(value, n) for all values in their order, zeros included."""
    spark = df.sparkSession
    order = spark.createDataFrame(list(enumerate(values)), f"position long, {column} string")
    return F.broadcast(order).join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select("position", column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def worth_an_artistic_read(route: Column, unrecoverable: Column, intentional: Column, uncertainty: Column, faces: Column, corrupt: Column) -> Column:
    """Why a frame is read (or 'no_…' why not), the first rule that holds."""
    return (
        F.when(corrupt, "no_corrupt").when(unrecoverable & (intentional < 40), "no_unrecoverable").when(route.isin("flagship", "stock_strong", "stock_standard"), "candidate").when(faces, "face")
        .when(intentional >= 55, "deliberate").when(uncertainty >= 60, "uncertain").when(route.isin("review", "duplicate_candidate"), "unresolved").otherwise("no_settled")
    )
