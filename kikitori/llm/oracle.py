"""SQL for those queries of the text problems that SQL can express."""

from __future__ import annotations

from kikitori.llm.lookalike import fold_table

_STEM = r"regexp_extract({0}, '([^/\\]*?)(\.[^./\\]*)?$', 1)"

P7_FOUND = f"""
WITH d AS (SELECT {_STEM.replace("{0}", "audio_file")} AS stem, duration, segments FROM diarization),
s AS (SELECT stem, CAST(round(x.start_s * 1000) AS BIGINT) AS a, CAST(round(x.end_s * 1000) AS BIGINT) AS b FROM (SELECT stem, unnest(segments) AS x FROM d)),
m AS (SELECT *, max(b) OVER (PARTITION BY stem ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM s WHERE a IS NOT NULL AND b > a),
g AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb THEN 1 ELSE 0 END) OVER (PARTITION BY stem ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m),
p AS (SELECT stem, max(b) - min(a) AS len FROM g GROUP BY stem, i),
t AS (SELECT stem, max(len) AS longest FROM p GROUP BY 1),
l AS (SELECT stem, max(CAST(round(duration * 1000) AS BIGINT)) AS ms FROM d GROUP BY 1),
r AS (SELECT row_id, coalesce(num_frames, CAST(floor(ms * 25.0 / 1000) AS BIGINT)) AS n, longest
  FROM (SELECT row_id, num_frames, {_STEM.replace("{0}", "latent_path")} AS stem FROM manifest) JOIN l USING (stem) LEFT JOIN t USING (stem))
SELECT row_id, 'oversized' AS kind FROM r WHERE n > 750 UNION ALL SELECT row_id, 'forced' FROM r WHERE n > 750 AND longest > 30000
"""



def _literal(text: str) -> str:
    return "'" + text.replace("\x00", "").replace("'", "''") + "'"


_FOLD = "regexp_replace(trim(translate({0}, " + ", ".join(map(_literal, fold_table())) + "), ' '), ' +', ' ', 'g')"
#: the look-alike form of every stored value; the composed form stands for equality under the collation
_FORMS = f"""WITH v AS (SELECT DISTINCT 'text' AS field_name, text AS value FROM manifest UNION SELECT 'speaker_id', speaker_id FROM manifest UNION SELECT 'caption', unnest(caption) FROM manifest),
f AS (SELECT field_name, value, {_FOLD.replace("{0}", "value")} AS raw FROM v WHERE value IS NOT NULL),
c AS (SELECT field_name, value, raw, nfc_normalize(raw) AS form FROM f),
k AS (SELECT field_name, value, count(*) OVER w AS n_members, first_value(value) OVER (w ORDER BY value <> raw, value) AS canonical FROM c WINDOW w AS (PARTITION BY field_name, form)),
members AS (SELECT * FROM k WHERE n_members > 1)
"""
_FORM = f"nfc_normalize({_FOLD.replace('{0}', 'speaker_id')})"
P3_FOUND = f"""
WITH RECURSIVE s AS (SELECT DISTINCT speaker_id, audio_file FROM manifest WHERE speaker_id IS NOT NULL),
i AS (SELECT speaker_id, {_FORM} AS form FROM (SELECT DISTINCT speaker_id FROM s)),
p AS (SELECT speaker_id, CASE WHEN contains(form, ':') THEN split_part(form, ':', 1) || ':' || split_part(substr(form, strpos(form, ':') + 1), '__', 1) ELSE form END AS person FROM i),
a AS (SELECT DISTINCT person, audio_file FROM s JOIN p USING (speaker_id) WHERE audio_file IS NOT NULL),
h AS (SELECT DISTINCT person, min(person) OVER (PARTITION BY audio_file) AS hub FROM a),
e AS (SELECT person AS u, hub AS v FROM h WHERE person <> hub UNION SELECT hub, person FROM h WHERE person <> hub),
r(node, seen) AS (SELECT DISTINCT person, person FROM p UNION SELECT e.v, r.seen FROM r JOIN e ON e.u = r.node),
o AS (SELECT node AS person, min(seen) AS component FROM r GROUP BY 1),
g AS (SELECT speaker_id, min(speaker_id) OVER w AS group_id, count(*) OVER w AS n FROM p JOIN o USING (person) WINDOW w AS (PARTITION BY component))
SELECT speaker_id, group_id FROM g WHERE n > 1
"""

SQL: dict[str, str] = {
    "p3_found": P3_FOUND,
    "p5_found": _FORMS + "SELECT a.field_name, a.value AS value_a, b.value AS value_b FROM c a JOIN c b ON a.field_name = b.field_name AND a.form = b.form AND a.value < b.value",
    "p5_members": _FORMS + "SELECT field_name, value, canonical, n_members FROM members",
    "p5_classes": _FORMS + "SELECT field_name, count(DISTINCT canonical) AS n_classes, count(*) AS n_values FROM members GROUP BY 1",
    "p5_canonical_speakers": _FORMS + "SELECT coalesce(canonical, speaker_id) AS speaker_id, count(*) AS n_rows FROM manifest LEFT JOIN members ON field_name = 'speaker_id' AND value = speaker_id GROUP BY 1",
    "p7_found": P7_FOUND,
}
