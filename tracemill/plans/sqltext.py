"""Pieces of the checking SQL that several queries share (written for DuckDB)."""

SPACE = r"[\t-\r\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def plain(x: str) -> str:
    return squeeze(f"lower({x})")


def folded(x: str) -> str:
    return squeeze(f"replace(lower({x}), 'ß', 'ss')")


def answer_tokens(x: str) -> str:
    spaced = f"regexp_replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[^0-9a-zA-Z]+', ' ', 'g')"
    return f"list_filter(string_split({spaced}, ' '), lambda t: t NOT IN ('a', 'an', 'the', ''))"


def overlap(p: str, g: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda z: z = t)), len(list_filter({g}, lambda z: z = t))))), 0)"


def scored(prediction: str, gold: str, source: str, keys: str) -> str:
    """A subquery with pt, gt (tokens), pn, gn (joined), hits, f1, exact, containment for rows of ``source``."""
    return f"""(
        SELECT *, pn <> '' AND pn = gn AS exact, pn <> '' AND gn <> '' AND (contains(gn, pn) OR contains(pn, gn)) AS containment,
            CASE WHEN len(pt) = 0 OR len(gt) = 0 OR hits = 0 THEN 0.0
                ELSE round(2 * (hits / len(pt)) * (hits / len(gt)) / ((hits / len(pt)) + (hits / len(gt))), 6) END AS f1
        FROM (SELECT *, array_to_string(pt, ' ') AS pn, array_to_string(gt, ' ') AS gn, CAST({overlap('pt', 'gt')} AS DOUBLE) AS hits
            FROM (SELECT {keys}, {answer_tokens(prediction)} AS pt, {answer_tokens(gold)} AS gt FROM {source})))"""


LADDER = "CASE WHEN exact THEN 1.0 WHEN containment THEN greatest(0.5, f1) WHEN f1 >= 0.75 THEN f1 ELSE 0.0 END"
LADDER_KIND = "CASE WHEN exact THEN 'exact' WHEN containment THEN 'containment' WHEN f1 >= 0.75 THEN 'token_f1' ELSE 'none' END"


def agent_action(x: str, source: str, keys: str) -> str:
    """A subquery with kind, valid, query, answer, reason of the action in ``x``."""
    return f"""(
        SELECT *, CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN ns = 1 THEN 'search' ELSE 'answer' END AS kind, reason IS NULL AS valid,
            CASE WHEN reason IS NULL AND ns = 1 THEN q END AS query, CASE WHEN reason IS NULL AND ns = 0 THEN a END AS answer
        FROM (SELECT *, CASE
                WHEN contains(raw, '<observation>') OR contains(raw, '</observation>') THEN 'model_generated_observation'
                WHEN ns + na > 1 AND contains(f, '<answer>') THEN 'nested_answer_in_search'
                WHEN ns + na > 1 THEN 'multiple_actions'
                WHEN ns = 1 AND (contains(f, '<answer>') OR contains(f, '</answer>')) THEN 'nested_answer_in_search'
                WHEN ns = 1 AND q = '' THEN 'empty_search'
                WHEN ns = 0 AND na = 1 AND a = '' THEN 'empty_answer'
                WHEN ns + na = 0 THEN 'no_valid_action' END AS reason
            FROM (SELECT *, len(s) AS ns, len(n) AS na, coalesce(s[1], '') AS f, {strip("coalesce(s[1], '')")} AS q, {strip("coalesce(n[1], '')")} AS a
                FROM (SELECT *, regexp_extract_all(raw, '(?s)<search>(.*?)</search>', 1) AS s, regexp_extract_all(raw, '(?s)<answer>(.*?)</answer>', 1) AS n
                    FROM (SELECT {keys}, coalesce({x}, '') AS raw FROM {source})))))"""


def lexical(queries: str, docs: str, k: int, pool: str = "") -> str:
    """The k best documents: ``queries`` has (pool,) qid, qtext; ``docs`` has (pool,) did, dtext."""
    p = f"{pool}, " if pool else ""
    on = lambda a, b: f"{a}.{pool} = {b}.{pool} AND " if pool else ""
    return f"""
        WITH qt AS (SELECT {p}qid, term, count(*) AS qtf FROM (SELECT {p}qid, unnest(regexp_extract_all(lower(qtext), '[a-z0-9]+')) AS term FROM {queries}) GROUP BY ALL),
        dt AS (SELECT {p}did, unnest(regexp_extract_all(lower(dtext), '[a-z0-9]+')) AS term FROM {docs}),
        tf AS (SELECT {p}did, term, count(*) AS tf FROM dt GROUP BY ALL),
        dl AS (SELECT {p}did, count(*) AS doc_len FROM dt GROUP BY ALL),
        df AS (SELECT {p}term, count(*) AS df FROM tf GROUP BY ALL),
        nd AS (SELECT {p}count(*) AS n_docs FROM {docs} {'GROUP BY ' + pool if pool else ''}),
        sc AS (SELECT {'qt.' + pool + ', ' if pool else ''}qid, tf.did, round(sum(qtf * (ln((n_docs + 1.0) / (df + 1.0)) + 1.0) * tf / doc_len), 6) AS score
            FROM qt JOIN tf ON {on('qt', 'tf')} qt.term = tf.term JOIN df ON {on('qt', 'df')} qt.term = df.term
            JOIN dl ON {on('tf', 'dl')} tf.did = dl.did {'JOIN nd ON qt.' + pool + ' = nd.' + pool if pool else ', nd'} GROUP BY ALL)
        SELECT {p}qid, did, score, row_number() OVER (PARTITION BY {p}qid ORDER BY score DESC, did) AS rank FROM sc WHERE score > 0
        QUALIFY rank <= {k}"""
