"""SQL that checks the shredded references and the changes of layouts."""

from __future__ import annotations

from tracemill.sources.drift import FAMILIES, LAYOUT_SHARE, TYPES

_REFS = """
    SELECT DISTINCT '{tab}' AS tab, CAST({key} AS VARCHAR) AS parent_id, r - 1 AS ref_no, c - 1 AS child_no, 0 AS sub_no
    FROM (SELECT *, unnest(range(1, len(refs) + 1)) AS r FROM (SELECT {key}, {refs} AS refs, {targets} AS targets FROM {tab} WHERE {key} IS NOT NULL)),
         unnest(range(1, len(targets) + 1)) AS x(c)
    WHERE targets[c].doc_id = refs[r]"""

# entries of a list (pairs or objects) and of a mapping, with the number of their sentences
_RAW = """
    j AS MATERIALIZED (SELECT raw_id, TRY_CAST(record AS JSON) AS j FROM raw_records),
    ctx AS (SELECT raw_id, j->'$.context' AS ctx, j->'$.supporting_facts' AS facts FROM j WHERE json_type(j) = 'OBJECT'),
    listed AS (SELECT raw_id, child_no, e, CASE json_type(e) WHEN 'ARRAY' THEN e->>'$[0]' ELSE e->>'$.title' END AS name,
                      CASE json_type(e) WHEN 'ARRAY' THEN e->'$[1]' ELSE coalesce(e->'$.sentences', e->'$.text') END AS s
               FROM (SELECT raw_id, unnest(range(CAST(json_array_length(ctx) AS BIGINT))) AS child_no, unnest(CAST(ctx AS JSON[])) AS e FROM ctx WHERE json_type(ctx) = 'ARRAY')),
    mapped AS (SELECT raw_id, row_number() OVER (PARTITION BY raw_id ORDER BY n) - 1 AS child_no, name, s
               FROM (SELECT raw_id, e.id AS n, e.key AS name, e.value AS s FROM ctx, json_each(ctx.ctx) e WHERE json_type(ctx.ctx) = 'OBJECT')),
    entries AS (SELECT raw_id, child_no, name, s FROM listed UNION ALL SELECT raw_id, child_no, name, s FROM mapped),
    parts AS (SELECT raw_id, child_no, name, CASE json_type(s) WHEN 'ARRAY' THEN json_array_length(s) WHEN 'VARCHAR' THEN 1 ELSE 0 END AS parts FROM entries WHERE name IS NOT NULL),
    fact AS (SELECT raw_id, ref_no, CASE json_type(f) WHEN 'ARRAY' THEN f->>'$[0]' ELSE f->>'$.title' END AS name,
                    CASE json_type(f) WHEN 'ARRAY' THEN f->>'$[1]' ELSE coalesce(f->>'$.sent_id', f->>'$.sent_idx') END AS no
             FROM (SELECT raw_id, unnest(range(CAST(json_array_length(facts) AS BIGINT))) AS ref_no, unnest(CAST(facts AS JSON[])) AS f FROM ctx WHERE json_type(facts) = 'ARRAY'))"""

P5_FOUND = f"""WITH {_RAW},
    raw AS (SELECT DISTINCT 'raw_records' AS tab, CAST(raw_id AS VARCHAR) AS parent_id, ref_no, child_no, sub_no
            FROM (SELECT raw_id, ref_no, name, CASE WHEN no IS NULL THEN 0 ELSE TRY_CAST(trim(no) AS INT) END AS sub_no FROM fact) JOIN parts USING (raw_id, name)
            WHERE sub_no >= 0 AND sub_no < parts)
    SELECT tab, parent_id, CAST(ref_no AS INT) AS ref_no, CAST(child_no AS INT) AS child_no, CAST(sub_no AS INT) AS sub_no FROM (
        SELECT * FROM raw UNION ALL {_REFS.format(tab="qa_examples", key="id", refs="gold_doc_ids", targets="corpus")}
        UNION ALL {_REFS.format(tab="rollouts_for_grpo", key="rollout_id", refs="metadata.gold_doc_ids", targets="metadata.candidate_passages")})"""

_PLAIN = "regexp_replace(lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g')), '(..)s$', '\\1')".format
_NAMES = ", ".join(f"('{f}', '{name}')" for name, fields in FAMILIES.items() for f in fields)
_ORDER = "list_position([" + ", ".join(f"'{t}'" for t in TYPES) + "], kind)"

P7_FOUND = f"""WITH family(field, meaning) AS (SELECT DISTINCT {_PLAIN("f")}, m FROM (VALUES {_NAMES}) v(f, m)),
    j AS MATERIALIZED (SELECT feed, file_name, delivered_at, TRY_CAST(record AS JSON) AS j FROM raw_records),
    files AS (SELECT feed, file_name, count(*) FILTER (json_type(j) = 'OBJECT') AS readable, row_number() OVER (PARTITION BY feed ORDER BY min(delivered_at), file_name) AS place
              FROM j WHERE file_name IS NOT NULL GROUP BY feed, file_name),
    counts AS (SELECT feed, file_name, field, kind, count(*) AS n FROM (
                   SELECT feed, file_name, e.key AS field, CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind
                   FROM j, json_each(j.j) e WHERE json_type(j.j) = 'OBJECT' AND e.type <> 'NULL') GROUP BY ALL),
    layout AS (SELECT f.feed, place, field, kind FROM (SELECT feed, file_name, field, sum(n) AS n, arg_max(kind, n * 10 - {_ORDER}) AS kind FROM counts GROUP BY ALL) c
               JOIN files f ON f.feed IS NOT DISTINCT FROM c.feed AND f.file_name = c.file_name WHERE n > readable * {LAYOUT_SHARE}),
    pairs AS (SELECT coalesce(n.feed, b.feed) AS feed, coalesce(n.place, b.place) AS place, n.field AS new, n.kind AS new_kind, b.field AS old, b.kind AS old_kind
              FROM layout n FULL JOIN (SELECT feed, place + 1 AS place, field, kind FROM layout) b ON n.feed IS NOT DISTINCT FROM b.feed AND n.place = b.place AND n.field = b.field),
    loose AS (SELECT p.*, row_number() OVER (PARTITION BY feed, place, meaning, new IS NULL ORDER BY coalesce(new, old)) AS nth
              FROM (SELECT p.*, coalesce(m.meaning, {_PLAIN("coalesce(new, old)")}) AS meaning FROM pairs p LEFT JOIN family m ON m.field = {_PLAIN("coalesce(new, old)")} WHERE new IS NULL OR old IS NULL) p),
    met AS (SELECT feed, place, max(old) AS old, max(new) AS new, max(old_kind) AS old_kind, max(new_kind) AS new_kind FROM loose GROUP BY feed, place, meaning, nth),
    changes AS (SELECT feed, place, 'type_changed' AS change, old, new FROM pairs WHERE old = new AND old_kind <> new_kind
                UNION ALL SELECT feed, place, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'renamed' END, old, new FROM met
                UNION ALL SELECT feed, place, 'type_changed', old, new FROM met WHERE old_kind <> new_kind)
    SELECT f.file_name, change, coalesce(old, '') AS old_field, coalesce(new, '') AS new_field
    FROM changes c JOIN files f ON f.feed IS NOT DISTINCT FROM c.feed AND f.place = c.place WHERE c.place > 1"""

GENERATED_ACTIONS = r"""SELECT rollout_id, prompt, '<search>' || array_to_string(list_filter(regexp_split_to_array(trim(prompt, E' \t\n\r'), '\s+'), lambda w: upper(w[1]) = w[1] AND lower(w[1]) <> w[1]), ' ') || '</search>' AS generated
    FROM rollouts_for_grpo"""

#: What ``damaged`` rows of the mock generator give, by the last digit of their number.
MOCK_VALIDATION = """SELECT CASE i % 6 WHEN 0 THEN 'valid' WHEN 1 THEN 'missing question' WHEN 2 THEN 'missing answer text' WHEN 3 THEN 'supporting_facts must cover at least two titles'
    WHEN 4 THEN 'answer appears in question' ELSE 'non-ascii text detected' END AS reason, count(*) AS n FROM range(1000) t(i) GROUP BY 1"""

_FOLD = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g'))".format
_TEXTS = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS VARCHAR[]) WHEN 'NULL' THEN [] ELSE coalesce([nullif({0}->>'$', NULL)], []) END".format

# rows of any layout with their entries, facts and answers as lists
_NORMAL = f"""
    j AS MATERIALIZED (SELECT raw_id, source, j FROM (SELECT raw_id, source, TRY_CAST(record AS JSON) AS j FROM raw_records) WHERE json_type(j) = 'OBJECT'),
    ctx AS (SELECT raw_id, j->'$.context' AS ctx, j->'$.supporting_facts' AS facts FROM j),
    listed AS (SELECT raw_id, child_no, CASE json_type(e) WHEN 'ARRAY' THEN e->>'$[0]' ELSE trim(coalesce(e->>'$.title', '')) END AS title,
                      CASE json_type(e) WHEN 'ARRAY' THEN e->'$[1]' WHEN 'OBJECT' THEN CASE WHEN coalesce(e->>'$.sentences', '') IN ('', '[]') THEN e->'$.text' ELSE e->'$.sentences' END END AS s
               FROM (SELECT raw_id, unnest(range(CAST(json_array_length(ctx) AS BIGINT))) AS child_no, unnest(CAST(ctx AS JSON[])) AS e FROM ctx WHERE json_type(ctx) = 'ARRAY')),
    mapped AS (SELECT raw_id, row_number() OVER (PARTITION BY raw_id ORDER BY n) - 1 AS child_no, title, s
               FROM (SELECT raw_id, e.id AS n, e.key AS title, e.value AS s FROM ctx, json_each(ctx.ctx) e WHERE json_type(ctx.ctx) = 'OBJECT')),
    entry AS (SELECT raw_id, child_no, title, CASE WHEN s IS NULL THEN [] ELSE {_TEXTS("s")} END AS sentences FROM (SELECT * FROM listed UNION ALL SELECT * FROM mapped)),
    fact AS (SELECT raw_id, ref_no, CASE json_type(f) WHEN 'ARRAY' THEN f->>'$[0]' ELSE f->>'$.title' END AS title,
                    coalesce(TRY_CAST(CASE json_type(f) WHEN 'ARRAY' THEN f->>'$[1]' ELSE coalesce(f->>'$.sent_id', f->>'$.sent_idx') END AS INT), 0) AS sent
             FROM (SELECT raw_id, unnest(range(CAST(json_array_length(facts) AS BIGINT))) AS ref_no, unnest(CAST(facts AS JSON[])) AS f FROM ctx WHERE json_type(facts) = 'ARRAY')),
    given AS (SELECT raw_id, source, coalesce(nullif(j->>'$._id', ''), nullif(j->>'$.id', ''), j->>'$.uid') AS row_id, coalesce(j->>'$.question', j->>'$.query_text') AS question,
                     CASE WHEN j->>'$.answers' IS NOT NULL THEN j->'$.answers' WHEN j->>'$.answer' IS NOT NULL THEN j->'$.answer' WHEN j->>'$.final_answer' IS NOT NULL THEN j->'$.final_answer' END AS a FROM j),
    normal AS (SELECT g.*, CASE WHEN a IS NULL THEN [] ELSE {_TEXTS("a")} END AS answers, coalesce(e.entries, []) AS entries, coalesce(f.facts, []) AS facts
               FROM given g LEFT JOIN (SELECT raw_id, list({{'title': title, 'sentences': sentences}} ORDER BY child_no) AS entries FROM entry GROUP BY raw_id) e USING (raw_id)
               LEFT JOIN (SELECT raw_id, list({{'title': title, 'sent': sent}} ORDER BY ref_no) AS facts FROM fact GROUP BY raw_id) f USING (raw_id))"""

# a supporting fact's sentence: of the last entry with its title that is long enough, null if it is blank
_REASONS = f"""
    found AS (SELECT f.raw_id, f.ref_no, arg_max(e.sentences[f.sent + 1], e.child_no) AS s FROM fact f JOIN entry e ON e.raw_id = f.raw_id AND e.title = f.title AND f.sent >= 0 AND len(e.sentences) > f.sent GROUP BY ALL),
    evidence AS (SELECT f.raw_id, list(CASE WHEN trim(d.s) <> '' THEN d.s END ORDER BY f.ref_no) AS ev FROM fact f LEFT JOIN found d USING (raw_id, ref_no) GROUP BY f.raw_id),
    judged AS (SELECT n.*, coalesce(ev, []) AS ev, [{_FOLD("x")} FOR x IN answers IF trim(x) <> ''] AS ans FROM normal n LEFT JOIN evidence USING (raw_id)),
    nth AS (SELECT *, list_position([x IS NULL FOR x IN ev], true) AS lost,
                   len([s FOR s IN ev IF len([a FOR a IN ans IF contains({_FOLD("s")}, a)]) > 0]) AS hits FROM judged),
    reasons AS (SELECT raw_id, row_id, CASE
        WHEN trim(coalesce(row_id, '')) = '' THEN 'missing id'
        WHEN trim(coalesce(question, '')) = '' THEN 'missing question'
        WHEN regexp_matches(concat_ws(' ', row_id, question, CAST(answers AS VARCHAR), CAST(entries AS VARCHAR), CAST(facts AS VARCHAR)), '[^\\x00-\\x7F]') THEN 'non-ascii text detected'
        WHEN len(answers) = 0 THEN 'missing answer, answers, or final_answer'
        WHEN len(ans) = 0 THEN 'missing answer text'
        WHEN len([s FOR s IN flatten([e.sentences FOR e IN entries]) IF trim(s) <> '']) = 0 THEN 'context has no sentences'
        WHEN len(facts) < 2 THEN 'supporting_facts must contain at least two facts'
        WHEN len(list_distinct([f.title FOR f IN facts])) < 2 THEN 'supporting_facts must cover at least two titles'
        WHEN lost > 0 THEN 'supporting fact missing from context: ' || facts[lost].title || ':' || facts[lost].sent
        WHEN len([a FOR a IN ans IF contains({_FOLD("question")}, a)]) > 0 THEN 'answer appears in question'
        WHEN list_has_any(ans, [{_FOLD("coalesce(e.title, '')")} FOR e IN entries]) THEN 'answer equals context title'
        WHEN hits > 1 THEN 'answer appears in multiple supporting sentences'
        WHEN len([a FOR a IN ans IF contains({_FOLD("array_to_string(ev, ' ')")}, a)]) = 0 THEN 'answer not found in supporting evidence'
        ELSE 'valid' END AS reason FROM nth)"""

VALIDATE_ROWS = f"WITH {_NORMAL}, {_REASONS} SELECT raw_id, row_id, reason FROM reasons"
REJECT_REASON_COUNTS = f"WITH {_NORMAL}, {_REASONS} SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM reasons GROUP BY 1"

_DOC = "concat_ws('::', source, row_id, {}, {})".format
QA_INGEST_PASSAGES = f"""WITH {_NORMAL},
    said AS (SELECT row_id, child_no * 1000000 + j - 1 AS pos, {_DOC("title", "j - 1")} AS doc_id, title, text
             FROM (SELECT row_id, source, child_no, title, unnest(sentences) AS text, unnest(range(1, len(sentences) + 1)) AS j FROM entry JOIN normal USING (raw_id)))
    SELECT doc_id, title, text FROM said QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY row_id NULLS FIRST, pos, title NULLS FIRST, text NULLS FIRST) = 1"""
QA_INGEST_EXAMPLES = f"""WITH {_NORMAL}
    SELECT DISTINCT row_id AS id, question, answers, [{_DOC("f.title", "f.sent")} FOR f IN facts] AS gold_doc_ids,
        flatten([[{_DOC("e.title", "k - 1")} FOR k IN range(1, len(e.sentences) + 1)] FOR e IN entries]) AS corpus_doc_ids FROM normal"""
