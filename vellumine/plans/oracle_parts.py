"""Common table expressions that several checks share: scores, classes, final scores, hash codes."""

from __future__ import annotations

from vellumine.params import ARTISTIC
from vellumine.plans.bindings import ASSET_SQL


def cl(x: str) -> str:
    return f"CAST(greatest(0.0, least(100.0, round_even({x}, 0))) AS BIGINT)"


SCORES = f"""{ASSET_SQL},
S1 AS (SELECT *, {cl('technical_quality')} AS current_quality,
  {cl("CASE WHEN is_raw THEN 100.0::DOUBLE ELSE 78.0::DOUBLE END - 11.0::DOUBLE * n_partial - 34.0::DOUBLE * n_unrecoverable")} AS recoverability,
  CASE WHEN present THEN axis_a ELSE 0 END AS content,
  CASE WHEN NOT is_best THEN {cl("12.0::DOUBLE - similarity * 10.0::DOUBLE")} WHEN cluster_size <= 1 THEN 100 ELSE {cl("100.0::DOUBLE - 9.0::DOUBLE * (cluster_size - 1) - similarity * 12.0::DOUBLE")} END AS uniqueness FROM A),
S2 AS (SELECT *, current_quality + uplift * (0.55::DOUBLE + 0.45::DOUBLE * recoverability / 100.0::DOUBLE) AS projected FROM S1),
S3 AS (SELECT *, {cl("CASE WHEN n_unrecoverable > 0 THEN least(projected, greatest(4.0::DOUBLE, 22.0::DOUBLE - 8.0::DOUBLE * (n_unrecoverable - 1))) ELSE projected END")} AS post_edit_potential FROM S2),
S4 AS (SELECT *, CASE WHEN present THEN {cl("0.55::DOUBLE * axis_b + 0.20::DOUBLE * axis_c + 0.25::DOUBLE * post_edit_potential")} ELSE {cl("post_edit_potential * 0.75::DOUBLE")} END AS aesthetic_potential,
  CASE WHEN present THEN {cl("0.58::DOUBLE * axis_a + 0.42::DOUBLE * post_edit_potential")} ELSE {cl("post_edit_potential * 0.80::DOUBLE * 0.85::DOUBLE")} END AS stock_potential FROM S3),
S5 AS (SELECT *, CASE WHEN present THEN 0.70::DOUBLE * (0.62::DOUBLE * aesthetic_potential + 0.38::DOUBLE * post_edit_potential) + 0.30::DOUBLE * axis_b ELSE 0.62::DOUBLE * aesthetic_potential + 0.38::DOUBLE * post_edit_potential END AS pbase,
  (100.0::DOUBLE - CASE WHEN present THEN 0.0 ELSE 30.0 END - CASE WHEN is_raw THEN 0.0 ELSE 8.0 END) * greatest(0.0, least(1.0, completeness)) - 5.0::DOUBLE * n_uncertain - CASE WHEN n_unrecoverable > 0 AND n_fixable > 0 AND n_partial = 0 THEN 10.0 ELSE 0.0 END AS sure FROM S4),
S6 AS (SELECT *, {cl("pbase * least(1.0::DOUBLE, post_edit_potential / 55.0::DOUBLE)")} AS portfolio_potential, {cl("sure")} AS confidence FROM S5),
S AS (SELECT *, {cl("(0.34::DOUBLE/0.94::DOUBLE) * post_edit_potential + (0.20::DOUBLE/0.94::DOUBLE) * aesthetic_potential + (0.18::DOUBLE/0.94::DOUBLE) * stock_potential + (0.12::DOUBLE/0.94::DOUBLE) * portfolio_potential + (0.10::DOUBLE/0.94::DOUBLE) * uniqueness")} AS routing_score FROM S6)"""

CLASSES = f"""{SCORES},
R AS (SELECT *, CASE WHEN n_fatal > 0 THEN 'unrecoverable' WHEN NOT is_best AND semantic_ran THEN 'duplicate_candidate' WHEN NOT is_best THEN 'duplicate_unchecked' WHEN n_unrecoverable > 0 AND post_edit_potential < 30 THEN 'capped'
  WHEN confidence < 55 THEN 'low_confidence' WHEN post_edit_potential < 30 THEN 'below_trash' WHEN flagship_selected AND NOT hero_blocked THEN 'flagship' WHEN flagship_selected THEN 'hero_blocked'
  WHEN stock_potential >= 68 THEN 'stock_strong' WHEN stock_potential >= 45 THEN 'stock_standard' ELSE 'archive' END AS reason_key FROM S),
C AS (SELECT *, CASE WHEN reason_key IN ('unrecoverable', 'capped') THEN 'trash' WHEN reason_key IN ('duplicate_candidate', 'duplicate_unchecked') THEN 'duplicate_candidate' WHEN reason_key = 'low_confidence' THEN 'review'
  WHEN reason_key = 'below_trash' THEN 'archive_only' WHEN reason_key = 'flagship' THEN 'flagship' WHEN reason_key IN ('stock_strong', 'stock_standard') THEN reason_key
  WHEN reason_key = 'hero_blocked' AND stock_potential >= 68 THEN 'stock_strong' WHEN reason_key = 'hero_blocked' AND stock_potential >= 45 THEN 'stock_standard' ELSE 'review' END AS route_class FROM R)"""

_ART = " + ".join(f"{w}::DOUBLE * art_{n}" for n, w in ARTISTIC.items())
FINAL = f"""{CLASSES},
F1 AS (SELECT *, present AND genre = 'portrait' AS is_portrait, coalesce(face_applies AND ((present AND genre = 'portrait') OR face_area >= 0.04), false) AS gates,
  coalesce(face_quality <= 45 AND face_publishability <= 50, false) AS bad_face, coalesce(face_confidence >= 60, false) AS face_sure,
  art_usable AND art_confidence >= 65 AND art_documentary_significance >= 78 AS up_doc, art_usable AND art_confidence >= 65 AND art_candidate AND art_distinctiveness >= 78 AS up_art, {cl(_ART)} AS c_art,
  {cl("0.70::DOUBLE * (0.40::DOUBLE * axis_b + 0.30::DOUBLE * axis_c + 0.30::DOUBLE * axis_a) + 0.30::DOUBLE * subject_strength")} AS c_sem,
  {cl("0.40::DOUBLE * face_publishability + 0.30::DOUBLE * face_quality + 0.15::DOUBLE * face_pose + 0.15::DOUBLE * face_sharpness")} AS c_face FROM C),
F2 AS (SELECT *, CASE WHEN gates AND face_sure AND (face_eyes_shut OR bad_face) THEN 'reject' WHEN gates AND NOT face_sure AND face_bad_expression THEN 'review' ELSE 'keep' END AS verdict,
  0.25::DOUBLE + 0.38::DOUBLE + CASE WHEN present THEN 0.18::DOUBLE ELSE 0.0 END + CASE WHEN gates THEN 0.11::DOUBLE ELSE 0.0 END + 0.08::DOUBLE AS w1, 0.50::DOUBLE + CASE WHEN present THEN 0.38::DOUBLE ELSE 0.0 END + 0.12::DOUBLE AS w0 FROM F1),
F3 AS (SELECT *, {cl("(0.25::DOUBLE / w1) * post_edit_potential + (0.38::DOUBLE / w1) * c_art + CASE WHEN present THEN (0.18::DOUBLE / w1) * c_sem ELSE 0.0 END + CASE WHEN gates THEN (0.11::DOUBLE / w1) * c_face ELSE 0.0 END + (0.08::DOUBLE / w1) * art_documentary_significance")} AS b1,
  {cl("(0.50::DOUBLE / w0) * post_edit_potential + CASE WHEN present THEN (0.38::DOUBLE / w0) * c_sem ELSE 0.0 END + (0.12::DOUBLE / w0) * (CASE WHEN present THEN axis_c ELSE 50 END)")} AS b0,
  present AND (NOT intended OR accidental >= 65) AS d_acc, present AND subject_strength <= 25 AS d_sub, n_unrecoverable > 0 AS d_unr, present AND dead_moment >= 65 AS d_dead,
  art_usable AND verdict = 'reject' AND NOT art_says_deliberate AND face_eyes_shut AS d_eyes, art_usable AND verdict = 'reject' AND NOT art_says_deliberate AND NOT face_eyes_shut AS d_expr, up_doc OR up_art AS veto FROM F2),
F4 AS (SELECT *, least(b0, CASE WHEN d_acc THEN 22 ELSE 100 END, CASE WHEN d_sub THEN 28 ELSE 100 END, CASE WHEN d_unr THEN 30 ELSE 100 END, CASE WHEN d_dead THEN 38 ELSE 100 END, 79) AS without_read,
  least(greatest(b1, CASE WHEN up_doc THEN 55 ELSE 0 END, CASE WHEN up_art THEN 58 ELSE 0 END), CASE WHEN d_acc AND NOT veto THEN 22 ELSE 100 END, CASE WHEN d_sub AND NOT veto THEN 28 ELSE 100 END, CASE WHEN d_unr THEN 30 ELSE 100 END,
    CASE WHEN coalesce(d_eyes, false) THEN 32 ELSE 100 END, CASE WHEN coalesce(d_expr, false) THEN 34 ELSE 100 END, CASE WHEN d_dead AND NOT veto THEN 38 ELSE 100 END) AS with_read,
  CASE WHEN d_acc AND NOT veto THEN 'accidental_frame' WHEN d_sub AND NOT veto THEN 'no_subject' WHEN d_unr THEN 'unrecoverable' WHEN d_eyes THEN 'eyes_closed' WHEN d_expr THEN 'bad_expression' WHEN d_dead AND NOT veto THEN 'dead_moment' END AS worst_defect FROM F3),
F5 AS (SELECT *, CAST(CASE WHEN art_usable THEN with_read ELSE without_read END AS BIGINT) AS final_score, CASE WHEN art_usable THEN b1 ELSE b0 END AS blended, veto AND (d_acc OR d_sub OR d_dead) AS vetoed,
  NOT art_usable OR art_confidence < 55 OR coalesce(gates AND (NOT face_sure OR (face_eyes_shut AND NOT art_says_deliberate) OR (face_bad_expression AND face_sure) OR (bad_face AND face_sure) OR face_quality < 70 OR (face_sharpness < 65 AND NOT art_says_deliberate) OR face_blink > 40 OR face_grimace > 40), false) AS blocked FROM F4),
K AS (SELECT *, CASE WHEN worst_defect IS NOT NULL THEN 'WEAK' WHEN final_score >= 85 AND art_usable AND art_confidence >= 60 AND NOT blocked AND c_art >= 62 THEN 'TOP' WHEN final_score < 45 THEN 'WEAK'
  WHEN art_usable AND abs(final_score - 45) <= 6 AND (art_uncertainty >= 70 OR verdict = 'review') THEN 'NEEDS_DECISION' WHEN present AND stock_potential >= 45 THEN 'GOOD_STOCK' ELSE 'GOOD_PERSONAL' END AS category FROM F5)"""

#: 64-bit sign codes of the vectors.
CODES = ASSET_SQL + ", H AS (SELECT *, " + " | ".join(f"(CASE WHEN vector[{i + 1}] > 0 THEN {f'(1::BIGINT << {i})' if i < 63 else '(-9223372036854775807 - 1)'} ELSE 0 END)" for i in range(64)) + " AS code FROM A)"

#: 64-bit hashes as a camera's frames have them: runs of three, the second one bit from the first and the third two.
HASH = """(((CAST(floor(key / 3) AS BIGINT) * 2654435761) % 2147483647) * 4294967296 + (CAST(floor(key / 3) AS BIGINT) * 2797491607 + 12345) % 4294967291)"""
HASHES = ASSET_SQL + f", H AS (SELECT *, xor(xor({HASH}, CASE WHEN key % 3 > 0 THEN 1::BIGINT << CAST(key // 3 % 61 AS INTEGER) ELSE 0 END), CASE WHEN key % 3 = 2 THEN 1::BIGINT << CAST((key // 3 * 7 + 5) % 61 AS INTEGER) ELSE 0 END) AS code FROM A)"
