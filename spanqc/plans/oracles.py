"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions.text import ACCENTED, bare
from ..operators import semantics as S
from .fixtures import FOREIGN, QUESTIONS

ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WORDS = r"len(regexp_extract_all({0}, '\S+'))"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
COLLAPSE = r"regexp_replace(regexp_replace(lower({0}), '\s+', ' ', 'g'), '^ | $', '', 'g')"
BARE = (
    r"regexp_replace(regexp_replace(regexp_replace(translate(lower({0}), " + quoted("".join(ACCENTED) + "“”‘’") + ", " + quoted("".join(map(bare, ACCENTED)) + "\"\"''")
    + r"), '\s+', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g'), '^ | $', '', 'g')"
)
ANSWER = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"
TOKENS = "list_filter(string_split(" + ANSWER + ", ' '), lambda t: t <> '')"
HASH = "('0x' || substr(md5({0}), 1, 8))::bigint"

CONTEXTS = f"""
contexts AS (
    SELECT doc_id, 'context_' || doc_id AS context_id, text AS context FROM documents WHERE {WORDS.format("text")} BETWEEN 82 AND 150
)"""
CANDIDATES = (
    CONTEXTS
    + ", questions(k, question) AS (VALUES " + ", ".join(f"({k}, {quoted(q)})" for k, q in QUESTIONS) + "), models(model) AS (VALUES ('a'), ('b'))"
    + f""", hashed AS (
    SELECT *, {HASH.format("doc_id || ':' || k || ':' || CASE WHEN doc_id % 4 = 0 THEN 'a' ELSE model END")} AS h FROM contexts, models, questions
), placed AS (
    SELECT *, h % 10 AS b, (h // 10) % 2 AS t, substr(context, h % greatest(length(context) - 40, 1) + 1, 24) AS s24, substr(context, h % greatest(length(context) - 40, 1) + 1, 3) AS s3 FROM hashed
), answered AS (
    SELECT *,
        CASE WHEN b <= 3 THEN trim(s24) WHEN b = 4 THEN trim(s3) WHEN b = 5 THEN replace(trim(s24), ' ', '  ') WHEN b = 6 THEN reverse(s24) WHEN b = 7 THEN 'RESPUESTA_NO_ENCONTRADA'
             WHEN b = 8 AND t = 0 THEN '' WHEN b = 8 THEN {quoted(FOREIGN)} WHEN t = 0 THEN trim(s24) ELSE 'RESPUESTA_NO_ENCONTRADA' END AS answer_text,
        CASE WHEN b = 7 OR b = 8 OR (b = 9 AND t = 0) THEN 'imposible' ELSE 'respondido' END AS is_impossible
    FROM placed
), stripped AS (
    SELECT *, {STRIP.format("answer_text")} AS ans FROM answered
), candidates AS (
    SELECT *, (CASE WHEN ans = '' THEN 0 ELSE greatest(strpos(context, ans) - 1, 0) END + CASE WHEN h % 13 = 0 THEN 1 ELSE 0 END)::bigint AS answer_start FROM stripped
)"""
)


def classified(form: str = COLLAPSE) -> str:
    """Candidates with their states; ``form`` is the normal form."""
    return (
        CANDIDATES
        + f""", counted AS (
    SELECT *, CASE WHEN ans = '' OR strpos(context, ans) = 0 THEN 0
                   ELSE len(list_filter(range(1, length(context) - length(ans) + 2), lambda i: substr(context, i, length(ans)) = ans)) END AS n,
           {form.format("context")} AS ctx_norm, {form.format("ans")} AS ans_norm
    FROM candidates
), decided AS (
    SELECT *, is_impossible = 'respondido' AND ans <> '' AND ans <> 'RESPUESTA_NO_ENCONTRADA' AS said FROM counted
), classified AS (
    SELECT *, said AND n > 0 AS literal_match,
        CASE WHEN is_impossible = 'imposible' AND ans = 'RESPUESTA_NO_ENCONTRADA' THEN 'no_answer_clean' WHEN is_impossible = 'imposible' AND ans = '' THEN 'no_answer_empty'
             WHEN is_impossible = 'imposible' AND n > 0 THEN 'imposible_but_span_present' WHEN is_impossible = 'imposible' THEN 'no_answer_free_text'
             WHEN NOT said THEN 'respondido_no_answer' WHEN n = 1 THEN 'extractive_valid_unique' WHEN n >= 2 THEN 'extractive_ambiguous'
             WHEN ans_norm <> '' AND contains(ctx_norm, ans_norm) THEN 'extractive_only_normalized' ELSE 'non_extractive_or_hallucinated' END AS qc_status,
        CASE WHEN said AND n > 0 THEN strpos(context, ans) - 1 ELSE -1 END AS start,
        said AND n > 0 AND substr(context, answer_start + 1, length(ans)) = ans AS offset_valid
    FROM decided
)"""
    )


def any_of(text: str, hints: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(h)})" for h in hints) + ")"


def hits(text: str, hints: list[str]) -> str:
    return "(" + " + ".join(f"(length({text}) - length(replace({text}, {quoted(h)}, ''))) // {len(h)}" for h in hints) + ")"


def found(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted('(?i)' + pattern)})"


def kind(question: str, keywords: list[tuple[str, list[str]]]) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(question, words)} THEN '{name}'" for name, words in keywords) + " ELSE 'otro' END"


def score(a: str, c: str, k: str) -> str:
    """The score of the current rules, written out."""
    near = f"substr({c}, greatest(0, strpos({c}, {a}) - 121) + 1, strpos({c}, {a}) - 1 + length({a}) + 120 - greatest(0, strpos({c}, {a}) - 121))"
    n = WORDS.format(a)
    return f"""CASE WHEN qc_status NOT IN ('extractive_valid_unique', 'extractive_ambiguous') THEN 0 ELSE CASE {k}
        WHEN 'hora' THEN CASE WHEN NOT {found(a, S.TIME)} THEN 1 WHEN strpos({c}, {a}) > 0 AND {any_of(near, S.TIME_CONTEXT)} THEN 1 ELSE 0 END
        WHEN 'fecha' THEN CASE WHEN {found(a, S.DATE)} THEN 0 ELSE 1 END
        WHEN 'valor' THEN CASE WHEN {found(a, S.MONEY)} THEN 0 ELSE 1 END
        WHEN 'lugar' THEN {found(a, S.DISTANCE)}::int + {any_of(a, S.VAGUE_PLACES)}::int + (NOT {any_of(a, S.PLACES)} AND {n} <= 2)::int
        WHEN 'objetos' THEN {any_of(a, S.VAGUE_OBJECTS)}::int + (NOT {any_of(a, S.OBJECTS)} AND {n} <= 2)::int + ({hits(c, S.OBJECTS)} > {hits(a, S.OBJECTS)} + 1)::int
        ELSE 0 END END"""


def old_score(a: str, k: str) -> str:
    n = WORDS.format(a)
    return f"""qc_status IN ('extractive_valid_unique', 'extractive_ambiguous') AND CASE {k}
        WHEN 'hora' THEN NOT {found(a, S.TIME_OLD)} OR {a} IN ({", ".join(map(quoted, S.GENERIC_TIMES))})
        WHEN 'fecha' THEN NOT {found(a, S.DATE_OLD)} WHEN 'valor' THEN NOT {found(a, S.MONEY_OLD)}
        WHEN 'lugar' THEN NOT {any_of(a, S.PLACES_OLD)} AND {n} <= 1 WHEN 'objetos' THEN NOT {any_of(a, S.OBJECTS_OLD)} AND {n} <= 1 ELSE false END"""


JUDGED = (
    classified()
    + f""", kinded AS (
    SELECT *, {BARE.format("question")} AS q_norm, {BARE.format("answer_text")} AS a_norm, {BARE.format("context")} AS c_norm FROM classified
), with_kind AS (
    SELECT *, {kind("q_norm", S.KIND_KEYWORDS)} AS kind FROM kinded
), judged AS (
    SELECT *, {old_score("a_norm", "kind")} AS v1, {score("a_norm", "c_norm", "kind")} AS score, ({score("a_norm", "c_norm", "kind")}) >= 1 AS flag FROM with_kind
)"""
)
KINDED = CANDIDATES + f", kinded AS (SELECT *, {BARE.format('question')} AS q_norm FROM candidates), with_kind AS (SELECT *, {kind('q_norm', S.KIND_KEYWORDS)} AS kind FROM kinded)"
STRICT = "((is_impossible = 'respondido' AND qc_status = 'extractive_valid_unique' AND offset_valid AND NOT flag) OR (is_impossible = 'imposible' AND qc_status IN ('no_answer_clean', 'no_answer_empty', 'no_answer_free_text')))"
EXPANDED = "(qc_status IN ('no_answer_clean', 'no_answer_empty', 'no_answer_free_text', 'extractive_valid_unique', 'extractive_ambiguous', 'extractive_only_normalized'))"
AUDITED = JUDGED + ", audited AS (SELECT *, CASE WHEN qc_status IN ('extractive_valid_unique', 'no_answer_clean') THEN (h % 5 > 0)::int ELSE (h % 3 = 0)::int END AS human_correct FROM judged)"
STRATUM = "CASE WHEN is_impossible = 'imposible' THEN 'no_answer' WHEN flag THEN 'heuristic_flag' WHEN qc_status = 'non_extractive_or_hallucinated' THEN 'non_extractive' WHEN qc_status = 'imposible_but_span_present' THEN 'impossible_but_span' ELSE 'positive_clean' END"
RECORD_ID = "model || '_' || context_id || '_' || substr(md5(question), 1, 8)"
SCORED = (
    KINDED
    + f""", refs AS (
    SELECT {RECORD_ID} AS id, kind, is_impossible = 'imposible' AS impossible, CASE WHEN is_impossible = 'imposible' THEN NULL ELSE ans END AS gold, h FROM with_kind WHERE model = 'a'
), said AS (
    SELECT *, CASE WHEN h % 4 < 2 THEN coalesce(gold, 'nada') WHEN h % 4 = 2 THEN substr(coalesce(gold, 'nada'), 1, 14) || ' El, extra' ELSE '' END AS prediction, (h % 400)::double / 100.0::double - 2 AS score FROM refs
), worded AS (
    SELECT *, {TOKENS.format("prediction")} AS p, {TOKENS.format("coalesce(gold, '')")} AS g FROM said
), shared AS (
    SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda y: y = t))))), 0)::double AS common FROM worded
), scored AS (
    SELECT *, CASE WHEN prediction = '' THEN impossible::int WHEN impossible THEN 0 ELSE (p = g)::int END::double AS em_kept,
           CASE WHEN prediction = '' THEN impossible::int::double WHEN impossible THEN 0.0 WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE 2.0::double * common / (len(p) + len(g)) END::double AS f1_kept,
           impossible::int::double AS blank
    FROM shared
), at_zero AS (
    SELECT *, CASE WHEN score > 0 THEN blank ELSE em_kept END AS em, CASE WHEN score > 0 THEN blank ELSE f1_kept END AS f1 FROM scored
)"""
)
SUMMARY = """coalesce(avg(em), 0) AS exact, coalesce(avg(f1), 0) AS f1, count(*) AS total,
    coalesce(avg(em) FILTER (NOT impossible), 0) AS has_ans_exact, coalesce(avg(f1) FILTER (NOT impossible), 0) AS has_ans_f1, count(*) FILTER (NOT impossible) AS has_ans_total,
    coalesce(avg(em) FILTER (impossible), 0) AS no_ans_exact, coalesce(avg(f1) FILTER (impossible), 0) AS no_ans_f1, count(*) FILTER (impossible) AS no_ans_total"""
WORDED = f"worded AS (SELECT doc_id, lang, source, n_chars, {WORDS.format('text')}::bigint AS words FROM documents)"
HISTORY = "history AS (SELECT day(ts)::double AS epoch, count(*) FILTER (value > 50)::double / count(*) AS eval_f1, min(value) AS best_t FROM events GROUP BY 1)"


def wilson(k: str, n: str, sign: str) -> str:
    p = f"({k}::double / {n})"
    return f"(({p} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n})) {sign} 1.96 * sqrt(({p} * (1 - {p}) + 3.8416 / (4 * {n})) / {n}) / (1 + 3.8416 / {n})"


def intervals(source: str, by: str, correct: str) -> str:
    return f"""
    SELECT {by}, n, correct, correct::double / n AS accuracy, {wilson("correct", "n", "-")} AS ci_lower, {wilson("correct", "n", "+")} AS ci_upper,
           ({wilson("correct", "n", "+")}) - ({wilson("correct", "n", "-")}) AS ci_width
    FROM (SELECT {by}, count(*)::double AS n_, count(*) AS n, sum({correct})::bigint AS correct FROM {source} GROUP BY {by})"""


def tail(statistic: str, dof: str) -> str:
    """The chance of a greater chi-square: one less the density's integral by Simpson's rule, over the root of the statistic."""
    u = f"(sqrt({statistic}) * i / 2000)"
    term = f"(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power({u}, {dof} - 1) * exp(-{u} * {u} / 2)"
    return f"round(1 - list_sum(list_transform(range(0, 2001), lambda i: {term})) * sqrt({statistic}) / 6000 * 2 / (power(2, {dof} / 2.0) * gamma({dof} / 2.0)), 7)"


def chi(source: str, a: str, b: str) -> str:
    return f"""
    , cells AS (SELECT {a} AS a, {b} AS b, count(*)::double AS seen FROM {source} GROUP BY 1, 2),
    r AS (SELECT a, sum(seen) AS rt FROM cells GROUP BY a), c AS (SELECT b, sum(seen) AS ct FROM cells GROUP BY b),
    sizes AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM c) AS nc, (SELECT sum(seen) FROM cells) AS total),
    grid AS (SELECT rt * ct / total AS wanted, abs(coalesce(seen, 0) - rt * ct / total) AS apart, (nr - 1) * (nc - 1) AS dof FROM r CROSS JOIN c CROSS JOIN sizes LEFT JOIN cells ON cells.a = r.a AND cells.b = c.b)
    , tested AS (SELECT dof, sum(power(CASE WHEN dof = 1 THEN apart - least(0.5, apart) ELSE apart END, 2) / wanted) AS chi2 FROM grid GROUP BY dof)
    SELECT *, {tail("chi2", "dof")} AS p FROM tested"""


def hash_key(seed: int, key: str) -> str:
    return f"md5('{seed}|' || {key})"


def split(source: str, key: str, tests: float, devs: float, seed: int) -> str:
    return f"""
    , ids AS (SELECT DISTINCT {key} AS key FROM {source}), ranked AS (SELECT key, row_number() OVER (ORDER BY {hash_key(seed, "key")}, key) - 1 AS place FROM ids),
    sizes AS (SELECT round_even((SELECT count(*) FROM ids) * {tests}, 0) AS t, round_even((SELECT count(*) FROM ids) * {devs}, 0) AS d),
    parts AS (SELECT key AS {key}, place, CASE WHEN place < t THEN 'test' WHEN place < t + d THEN 'validation' ELSE 'train' END AS split FROM ranked, sizes)"""


def oracle(**sql: str) -> None:
    ORACLES.update(sql)


oracle(
    word_range_filter=f"WITH {CONTEXTS} SELECT doc_id, context_id, {WORDS.format('context')}::bigint AS words FROM contexts",
    clean_answers=f"WITH {CANDIDATES} SELECT model, count(*) AS n FROM candidates WHERE is_impossible <> 'imposible' AND {WORDS.format('answer_text')} > 0 GROUP BY model",
    length_thresholds=f"WITH {WORDED} SELECT lang, count(*) FILTER (words < 17) AS under_17, count(*) FILTER (words < 100) AS under_100, count(*) FILTER (words > 30) AS over_30, count(*) FILTER (words > 100) AS over_100 FROM worded GROUP BY lang",
    iqr_filter=f"""WITH {WORDED}, q AS (SELECT quantile_cont(words, 0.25) AS q1, quantile_cont(words, 0.75) AS q3 FROM worded)
        SELECT q1, q3, q1 - 1.5::double * (q3 - q1) AS lower, q3 + 1.5::double * (q3 - q1) AS upper, (SELECT count(*) FROM worded WHERE words >= q1 - 1.5 * (q3 - q1) AND words <= 100) AS kept FROM q""",
    model_columns=f"""WITH {KINDED}, named AS (
        SELECT CASE kind WHEN 'hora' THEN 'time' WHEN 'fecha' THEN 'date' WHEN 'valor' THEN 'value' WHEN 'lugar' THEN 'place' WHEN 'objetos' THEN 'objects' ELSE 'other' END AS kind_en,
               CASE WHEN is_impossible = 'imposible' THEN 'impossible' WHEN kind = 'hora' THEN 'timed' ELSE 'other' END AS state, model, doc_id FROM with_kind)
        SELECT kind_en AS kind, state, 'audit' AS origin, model, count(*) AS n, max(doc_id) AS last_context FROM named GROUP BY ALL""",
    membership_filter=f"""WITH {CANDIDATES} SELECT is_impossible, count(*) AS n FROM candidates c WHERE model = 'b' AND EXISTS (
        SELECT 1 FROM candidates k WHERE k.model = 'a' AND k.is_impossible = 'respondido' AND k.context = c.context AND k.question = c.question) GROUP BY is_impossible""",
    limited_contexts=f"WITH {CONTEXTS} SELECT context_id FROM contexts ORDER BY context_id LIMIT 25",
    structural_report=f"""WITH {CANDIDATES}, per_context AS (SELECT model, context_id, count(DISTINCT question) AS q FROM candidates GROUP BY 1, 2),
        complete AS (SELECT model, count(*) FILTER (q = 5) AS complete_contexts, count(*) AS contexts FROM per_context GROUP BY model)
        SELECT c.model, count(*) AS rows, count(*) AS required_ok, count(*) FILTER (is_impossible IN ('respondido', 'imposible')) AS label_ok, count(*) - count(DISTINCT context_id || '/' || question) AS duplicate_keys,
               any_value(complete_contexts) AS complete_contexts, any_value(contexts) AS contexts, count(DISTINCT question) AS questions, 100.0::double AS valid_rate
        FROM candidates c JOIN complete USING (model) GROUP BY c.model""",
    record_errors=f"""WITH {classified()}, spans AS (
        SELECT model, CASE WHEN is_impossible = 'imposible' THEN 'none' WHEN model = 'a' AND start < 0 THEN 'answerable_without_one_span'
            WHEN model = 'b' AND (start < 0 OR substr(context, start + 1, length(answer_text)) <> answer_text) THEN 'offset_mismatch' ELSE 'none' END AS error FROM classified)
        SELECT model AS split, error, count(*) AS n FROM spans GROUP BY 1, 2""",
    readiness=f"""WITH {classified()}, recs AS (
        SELECT model AS split, {RECORD_ID} AS id, context_id, is_impossible = 'imposible' AS imp, is_impossible <> 'imposible' AND model = 'a' AND start < 0 AS awa,
               is_impossible <> 'imposible' AND (start < 0 OR (model = 'b' AND substr(context, start + 1, length(answer_text)) <> answer_text)) AS bad FROM classified)
        SELECT split, count(*) AS rows, count(DISTINCT context_id) AS contexts, count(*) FILTER (NOT imp) AS answerable, count(*) FILTER (imp) AS impossible,
               round_even(count(*) FILTER (imp) * 100.0::double / count(*), 2) AS impossible_rate, 0::bigint AS impossible_with_answers, count(*) FILTER (awa) AS answerable_without_answers,
               count(*) FILTER (bad) AS invalid_offsets, count(*) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (bad) AS schema_errors FROM recs GROUP BY split""",
    squad_records=f"""WITH {classified()} SELECT {RECORD_ID} AS id, context_id, is_impossible = 'imposible' AS is_impossible,
        CASE WHEN is_impossible <> 'imposible' AND start >= 0 THEN ans END AS answer, CASE WHEN is_impossible <> 'imposible' AND start >= 0 THEN start::int END AS answer_start FROM classified""",
    legacy_records=f"""WITH {CANDIDATES}, flat AS (
        SELECT context_id || '-' || k AS index, context, substr(context, answer_start::int, length(answer_text)::int + 1) AS raw, answer_start - 1 AS start, is_impossible = 'imposible' AS imp FROM candidates WHERE model = 'a' AND answer_start >= 1),
        cleaned AS (SELECT *, {STRIP.format("raw")} AS text, length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS blanks FROM flat)
        SELECT 'legacy_' || index AS id, 'ctx_' || substr(md5(context), 1, 12) AS context_id, imp AS is_impossible, CASE WHEN NOT imp THEN text END AS answer,
               CASE WHEN NOT imp THEN (CASE WHEN substr(context, (start + 1)::int, length(text)::int) <> text AND substr(context, (start + blanks + 1)::int, length(text)::int) = text THEN start + blanks ELSE start END)::int END AS answer_start FROM cleaned""",
    turn_completeness="SELECT conv_id, count(*) AS n_rows FROM conversations GROUP BY conv_id HAVING count(*) <> 4",
    resume_scan=f"""WITH {CANDIDATES}, live AS (SELECT * FROM candidates WHERE model = 'a' AND h % 7 <> 0), done AS (SELECT context_id FROM live GROUP BY 1 HAVING count(*) = 5)
        SELECT question, count(*) AS n, (SELECT count(*) FROM done) AS finished FROM live WHERE context_id IN (SELECT context_id FROM done) GROUP BY question""",
    gold_leakage=f"""WITH {CANDIDATES}, gold AS (SELECT DISTINCT context, question FROM candidates WHERE model = 'a' AND h % 11 = 0) SELECT model AS split, count(*) AS n FROM candidates JOIN gold USING (context, question) GROUP BY model""",
    span_location=f"""WITH {CANDIDATES}, located AS (SELECT *, CASE WHEN ans = '' THEN 0 ELSE strpos(context, answer_text) END AS p FROM candidates)
        SELECT context_id, model, k::bigint AS k, CASE WHEN p > 0 THEN p - 1 ELSE 0 END::bigint AS answer_start, CASE WHEN p > 0 THEN p - 1 + length(answer_text) ELSE 0 END::bigint AS answer_end,
               CASE WHEN p > 0 THEN 'respondido' ELSE 'imposible' END AS is_impossible, contains(context, answer_text) AS found_in_context FROM located""",
    occurrence_counts=f"""WITH {CANDIDATES} SELECT context_id, model, k::bigint AS k, len(list_filter(range(1, length(context)), lambda i: substr(context, i, 2) = substr(context, 2, 2)))::bigint AS overlapping,
        {hits("context", ["en", "er", "ou"])}::bigint AS hits FROM candidates""",
    qc_status_counts=f"WITH {classified()} SELECT model, qc_status, count(*) AS n FROM classified GROUP BY 1, 2",
    qc_status_rows=f"""WITH {classified()} SELECT context_id, model, k::bigint AS k, literal_match, literal_match OR qc_status = 'extractive_only_normalized' AS norm_match,
        CASE WHEN said OR is_impossible = 'imposible' THEN n ELSE 0 END::bigint AS literal_match_count, start::bigint AS recomputed_answer_start, offset_valid AS provided_offset_valid, qc_status,
        {WORDS.format("answer_text")}::bigint AS answer_words FROM classified""",
    qc_status_accents=f"WITH {classified(BARE)} SELECT model, qc_status, count(*) AS n FROM classified GROUP BY 1, 2",
    qc_status_exact=f"WITH {classified(BARE)} SELECT model, qc_status, count(*) AS n FROM classified GROUP BY 1, 2",
    passage_containment="SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    kind_breakdown=f"WITH {KINDED} SELECT kind, {kind('q_norm', S.OLD_KIND_KEYWORDS)} AS old_kind, count(*) AS n FROM with_kind GROUP BY 1, 2",
    semantic_flags=f"WITH {JUDGED} SELECT model, kind AS question_kind, count(*) FILTER (v1) AS v1, count(*) FILTER (flag) AS v2, sum(score)::bigint AS score FROM judged GROUP BY 1, 2",
    audit_flags=f"""WITH {JUDGED}, low AS (SELECT * EXCLUDE (score), {COLLAPSE.format("answer_text")} AS a_low, {COLLAPSE.format("context")} AS c_low FROM judged)
        SELECT model, kind AS question_kind, count(*) FILTER (({score("a_low", "c_low", "kind")}) >= 1) AS flagged FROM low GROUP BY 1, 2""",
    toy_rules=f"""WITH {JUDGED}, low AS (SELECT model, kind, qc_status, {COLLAPSE.format("answer_text")} AS a, {COLLAPSE.format("context")} AS c FROM judged), near AS (
        SELECT *, substr(c, greatest(0, strpos(c, a) - 31) + 1, strpos(c, a) - 1 + length(a) + 30 - greatest(0, strpos(c, a) - 31)) AS around FROM low)
        SELECT kind, sum(CASE WHEN qc_status NOT IN ('extractive_valid_unique', 'extractive_ambiguous') THEN 0 ELSE CASE kind
            WHEN 'hora' THEN (NOT {found("a", r"\bthe\b")})::int + ({found("a", r"\bthe\b")} AND strpos(c, a) > 0 AND contains(around, 'tion'))::int
            WHEN 'valor' THEN (NOT contains(a, 'er') AND {WORDS.format("a")} <= 3)::int
            WHEN 'lugar' THEN ({hits("c", ["en", "th"])} > {hits("a", ["en", "th"])} + 20)::int ELSE 0 END END)::bigint AS score FROM near GROUP BY kind""",
)

PAIRS = JUDGED + ", pairs AS (SELECT a.context_id, a.question, a.context, " + ", ".join(f"{x}.{c} AS {c}_{x}" for x in "ab" for c in ("answer_text", "is_impossible", "qc_status", "offset_valid", "flag", "start", "a_norm", "ans")) + " FROM judged a JOIN judged b USING (context_id, question) WHERE a.model = 'a' AND b.model = 'b'), same AS (SELECT *, a_norm_a = a_norm_b AND ans_a <> '' AS same FROM pairs), agreed AS (SELECT *, CASE WHEN is_impossible_a = 'respondido' AND is_impossible_b = 'respondido' AND same THEN 'agree_exact' WHEN is_impossible_a = 'respondido' AND is_impossible_b = 'respondido' THEN 'disagree_span' WHEN is_impossible_a <> 'respondido' AND is_impossible_b <> 'respondido' THEN 'agree_no_answer' ELSE 'disagree_answerability' END AS agreement FROM same)"
GOOD = "is_impossible_{0} = 'respondido' AND qc_status_{0} = 'extractive_valid_unique' AND offset_valid_{0} AND NOT flag_{0}"

oracle(
    agreement_pairs=f"WITH {PAIRS} SELECT context_id, question, agreement FROM agreed",
    agreement_rates=f"""WITH {PAIRS} SELECT count(*) AS n_pairs, count(*) FILTER (agreement <> 'disagree_answerability')::double / count(*) AS answerability_agreement,
        count(*) FILTER (agreement = 'agree_exact')::double / count(*) FILTER (agreement IN ('agree_exact', 'disagree_span')) AS exact_agreement,
        count(*) FILTER (agreement = 'agree_no_answer')::double / count(*) AS no_answer_agreement, count(*) FILTER (agreement = 'disagree_answerability')::double / count(*) AS disagreement FROM agreed""",
    merged_policy=f"""WITH {PAIRS}, picked AS (SELECT *, CASE WHEN is_impossible_a = 'imposible' AND is_impossible_b = 'imposible' THEN 'both' WHEN same AND offset_valid_a THEN 'a' WHEN same AND start_b >= 0 THEN 'b'
            WHEN {GOOD.format("a")} THEN 'a' WHEN {GOOD.format("b")} THEN 'b' END AS model FROM agreed)
        SELECT context_id, question, model, CASE model WHEN 'both' THEN 'imposible' ELSE 'respondido' END AS is_impossible, CASE model WHEN 'both' THEN 'RESPUESTA_NO_ENCONTRADA' WHEN 'a' THEN answer_text_a ELSE answer_text_b END AS answer_text,
               CASE model WHEN 'both' THEN -1 WHEN 'a' THEN start_a ELSE start_b END::bigint AS recomputed_answer_start FROM picked WHERE model IS NOT NULL""",
    merged_contexts=f"""WITH {PAIRS}, picked AS (SELECT *, CASE WHEN is_impossible_a = 'imposible' AND is_impossible_b = 'imposible' THEN 'both' WHEN same AND offset_valid_a THEN 'a' WHEN same AND start_b >= 0 THEN 'b'
            WHEN {GOOD.format("a")} THEN 'a' WHEN {GOOD.format("b")} THEN 'b' END AS model, split_part(context_id, '_', 2)::bigint % 3 AS part FROM agreed)
        SELECT context_id, question, CASE WHEN part = 1 THEN md5(context) END AS context, model, CASE model WHEN 'both' THEN 'RESPUESTA_NO_ENCONTRADA' WHEN 'a' THEN answer_text_a ELSE answer_text_b END AS answer_text
        FROM picked WHERE model IS NOT NULL AND part > 0""",
    unmatched_pairs=f"""WITH {CANDIDATES}, a AS (SELECT context_id, question FROM candidates WHERE model = 'a' AND h % 5 <> 0), b AS (SELECT context_id, question FROM candidates WHERE model = 'b' AND h % 3 <> 0),
        onlys AS (SELECT 'a' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT only_in, count(*) AS n FROM onlys GROUP BY 1""",
    positional_pairs=f"""WITH {CANDIDATES} SELECT a.context_id, a.k::bigint AS k, a.question, a.is_impossible = b.is_impossible AS same_label, a.answer_text = b.answer_text AS same_text
        FROM candidates a JOIN candidates b ON a.context_id = b.context_id AND a.k = b.k WHERE a.model = 'a' AND b.model = 'b'""",
    suffix_pairs=f"""WITH {CANDIDATES} SELECT a.doc_id AS context_number, a.question, a.context_id AS context_id_a, 'row-' || b.doc_id AS context_id_b, a.is_impossible = b.is_impossible AS same_label
        FROM candidates a JOIN candidates b ON a.doc_id = b.doc_id AND a.question = b.question WHERE a.model = 'a' AND b.model = 'b' AND b.doc_id % 3 <> 0""",
    split_accuracy="""WITH d AS (SELECT source, lang, count(*) AS n_docs FROM documents GROUP BY 1, 2), l AS (SELECT source, lang, avg(quality) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
        SELECT source, lang, n_docs, accuracy FROM d LEFT JOIN l USING (source, lang)""",
    reference_lookup=f"WITH {SCORED} SELECT impossible AS is_impossible, count(*) AS n FROM scored GROUP BY 1",
    index_selection=f"WITH {CONTEXTS} SELECT CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'chosen' ELSE 'left' END AS part, doc_id FROM contexts",
    gold_exclusion=f"""WITH {CANDIDATES}, gold AS (SELECT DISTINCT context, question FROM candidates WHERE model = 'a' AND h % 11 = 0)
        SELECT model, count(*) AS n FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.context = c.context AND g.question = c.question) GROUP BY model""",
    gold_overlap=f"""WITH {CANDIDATES} SELECT count(*) AS n FROM (SELECT context, question FROM candidates WHERE model = 'a' AND h % 11 = 0 INTERSECT SELECT context, question FROM candidates WHERE is_impossible = 'imposible')""",
    strict_expanded_uncertain=f"""WITH {JUDGED}, sets AS (SELECT model, {STRICT} AS in_strict, {EXPANDED} AS in_expanded FROM judged)
        SELECT model, in_strict, in_expanded, NOT in_strict AND NOT in_expanded AS in_uncertain, count(*) AS n FROM sets GROUP BY ALL""",
    gold_set=f"""WITH {CANDIDATES}, gold AS (SELECT *, is_impossible = 'imposible' AS imp, is_impossible <> 'imposible' AND ans <> '' AS has, strpos(context, ans) - 1 AS pos FROM candidates WHERE model = 'a' AND h % 11 = 0)
        SELECT 'gold_' || context_id || '-' || k AS id, imp AS is_impossible, CASE WHEN has THEN ans END AS answer, CASE WHEN has THEN pos END::bigint AS answer_start, CASE WHEN has THEN greatest(pos, 0) END::bigint AS clamped_start FROM gold""",
    gold_accuracy=f"""WITH {AUDITED}, sets AS (SELECT 'strict' AS dataset, human_correct FROM audited WHERE model = 'a' AND h % 4 = 0 AND {STRICT} UNION ALL SELECT 'expanded', human_correct FROM audited WHERE model = 'a' AND h % 4 = 0 AND {EXPANDED})
        SELECT dataset, n, correct, correct::double / n AS accuracy, {wilson("correct", "n", "-")} AS ci_lower, {wilson("correct", "n", "+")} AS ci_upper FROM (SELECT dataset, count(*) AS n, sum(human_correct)::bigint AS correct FROM sets GROUP BY 1)""",
    hash_sample=f"WITH {CONTEXTS} SELECT context_id FROM contexts ORDER BY {hash_key(42, 'context_id')}, context_id LIMIT 50",
    stratified_audit_hash=f"""WITH {JUDGED}, strata AS (
            SELECT *, 0 AS stratum, 24 AS quota FROM judged WHERE literal_match AND NOT flag UNION ALL SELECT *, 1, 12 FROM judged WHERE is_impossible = 'imposible' UNION ALL SELECT *, 2, 12 FROM judged WHERE flag
            UNION ALL SELECT *, 3, 6 FROM judged WHERE qc_status = 'non_extractive_or_hallucinated' UNION ALL SELECT *, 4, 6 FROM judged WHERE qc_status = 'imposible_but_span_present'),
        drawn AS (SELECT model, context_id, question, stratum, quota, row_number() OVER (PARTITION BY model, stratum ORDER BY {hash_key(42, "context_id || '|' || question")}, context_id, question) AS n FROM strata),
        firsts AS (SELECT *, row_number() OVER (PARTITION BY model, context_id, question ORDER BY stratum, n) AS rn FROM drawn WHERE n <= quota),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY stratum, n) AS place FROM firsts WHERE rn = 1)
        SELECT model, context_id, question, stratum::bigint AS stratum, place FROM numbered WHERE place <= 60""",
    audit_strata=f"WITH {JUDGED} SELECT model, {STRATUM} AS stratum, count(*) AS n FROM judged GROUP BY 1, 2",
    context_split_hash=f"WITH {CONTEXTS} {split('contexts', 'context_id', 0.1, 0.1, 42)} SELECT context_id, split FROM parts",
    row_split_hash=f"WITH {SCORED} {split('refs', 'id', 0.2, 0.0, 7)} SELECT id, split FROM parts",
    ordered_shards=f"WITH {CONTEXTS}, placed AS (SELECT context_id, row_number() OVER (ORDER BY context_id) - 1 AS place FROM contexts) SELECT context_id, place, place % 4 AS shard FROM placed",
    stride_shards=f"WITH {CONTEXTS} {split('contexts', 'context_id', 0.1, 0.1, 42)} SELECT context_id, place, place % 4 AS shard FROM parts",
    experiment_splits=f"""WITH {JUDGED}, own AS (SELECT * FROM judged WHERE model = 'a') {split("own", "context_id", 0.15, 0.15, 42)}
        SELECT split, count(*) AS n FROM own JOIN parts USING (context_id) WHERE split <> 'train' OR {STRICT} GROUP BY split""",
    longest_contexts="SELECT doc_id, length(text) AS chars FROM documents ORDER BY chars DESC, doc_id LIMIT 20",
    top3_per_group="SELECT * FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 3",
    first_duplicates="SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    union_with_nulls="SELECT quality, lang, count(*) AS n FROM (SELECT quality::bigint AS quality, NULL AS lang FROM labels UNION ALL SELECT NULL, lang FROM documents) GROUP BY ALL",
    em_f1_rows=f"WITH {SCORED} SELECT id, em_kept, round(f1_kept, 9) AS f1_kept, em, round(f1, 9) AS f1 FROM at_zero",
    squad_metrics=f"WITH {SCORED} SELECT {SUMMARY} FROM at_zero",
    metrics_by_kind=f"WITH {SCORED} SELECT kind, {SUMMARY} FROM at_zero GROUP BY kind",
    threshold_sweep=f"""WITH {SCORED} SELECT t.score AS threshold, round(avg(CASE WHEN s.score > t.score THEN s.blank ELSE s.em_kept END), 9) AS exact, round(avg(CASE WHEN s.score > t.score THEN s.blank ELSE s.f1_kept END), 9) AS f1
        FROM (SELECT DISTINCT score FROM scored UNION ALL SELECT '-inf'::double UNION ALL SELECT 'inf'::double) t, scored s GROUP BY 1""",
    best_thresholds=f"""WITH {SCORED}, thresholds AS (SELECT DISTINCT score AS th FROM scored UNION ALL SELECT -1e9 UNION ALL SELECT 1e9),
        swept AS (SELECT th, avg(CASE WHEN score > th THEN blank ELSE em_kept END) AS e, avg(CASE WHEN score > th THEN blank ELSE f1_kept END) AS f FROM thresholds, scored GROUP BY th)
        SELECT round(max(e), 9) AS best_exact, round(max(f), 9) AS best_f1 FROM swept""",
    dev_tuned_threshold=f"""WITH {SCORED}, {HISTORY}, tried AS (
        SELECT t.score AS t, avg(CASE WHEN s.score > t.score THEN s.blank ELSE s.f1_kept END) AS f1 FROM (SELECT DISTINCT score FROM scored UNION ALL SELECT '-inf'::double UNION ALL SELECT 'inf'::double) t, scored s GROUP BY 1),
        modes AS (SELECT 'plain' AS mode, 0.0::double AS t UNION ALL (SELECT 'headline', best_t FROM history ORDER BY eval_f1 DESC, epoch LIMIT 1) UNION ALL (SELECT 'oracle', t FROM tried ORDER BY round(f1, 12) DESC, t LIMIT 1))
        SELECT mode, round(t, 9) AS threshold, round(avg(CASE WHEN score > t THEN blank ELSE em_kept END), 9) AS exact, round(avg(CASE WHEN score > t THEN blank ELSE f1_kept END), 9) AS f1, count(*) AS total FROM modes, scored GROUP BY mode, t""",
    plateau=f"""WITH {HISTORY}, marked AS (SELECT epoch, eval_f1, eval_f1 - lag(eval_f1) OVER (ORDER BY epoch) AS delta, max(eval_f1) OVER (ORDER BY epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS future_best FROM history)
        SELECT epoch, round(eval_f1, 9) AS eval_f1, round(delta, 9) AS delta, round(future_best, 9) AS future_best,
               coalesce(epoch = (SELECT min(epoch) FROM marked WHERE epoch >= 3 AND future_best - eval_f1 < 0.03), false) AS is_plateau, epoch = (SELECT epoch FROM history ORDER BY history.eval_f1 DESC, epoch LIMIT 1) AS is_best FROM marked""",
    epoch_rows="SELECT day(ts)::bigint AS epoch, arg_max(value, event_id) FILTER (event_type = 'click') AS loss, arg_max(value, event_id) FILTER (user_id % 2 = 0) AS eval FROM events GROUP BY 1",
    confusion_metrics=f"""WITH {AUDITED}, c AS (SELECT model, kind AS question_kind, count(*) AS n, count(*) FILTER (flag AND human_correct = 0) AS tp, count(*) FILTER (flag AND human_correct = 1) AS fp,
            count(*) FILTER (NOT flag AND human_correct = 0) AS fn, count(*) FILTER (NOT flag AND human_correct = 1) AS tn FROM audited WHERE is_impossible = 'respondido' GROUP BY 1, 2),
        d AS (SELECT *, tp::double / nullif(tp + fp, 0) AS precision, tp::double / nullif(tp + fn, 0) AS recall FROM c) SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM d""",
    wilson_by_group="WITH labelled AS (SELECT lang, quality FROM labels JOIN documents USING (doc_id)) " + intervals("labelled", "lang", "quality"),
    stratum_accuracy=f"WITH {AUDITED}, s AS (SELECT model, {STRATUM} AS stratum, human_correct FROM audited) " + intervals("s", "model, stratum", "human_correct"),
    two_prop_z=f"""WITH {AUDITED}, s AS (SELECT count(*) FILTER (model = 'a')::double AS n1, count(*) FILTER (model = 'b')::double AS n2, count(*) FILTER (model = 'a' AND human_correct = 1)::double AS k1, count(*) FILTER (model = 'b' AND human_correct = 1)::double AS k2 FROM audited)
        SELECT *, (k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS z, {tail("power(z, 2)", "1")} AS p FROM s""",
    chi_square=f"WITH {AUDITED} " + chi("audited", "model", "human_correct"),
    chi_square_languages="WITH labelled AS (SELECT lang, quality FROM labels JOIN documents USING (doc_id)) " + chi("labelled", "lang", "quality"),
    margins=f"WITH {CANDIDATES} SELECT model, 1.96::double * sqrt(0.25::double / count(*)) AS worst_margin, ceil(1.96 * 1.96 * 0.25 / 0.0025)::bigint AS rows_for_5_points FROM candidates GROUP BY model",
    abstention_report=f"""WITH {classified()} SELECT model, count(*) FILTER (is_impossible = 'respondido') AS answered, count(*) FILTER (is_impossible = 'imposible') AS impossible, count(*) FILTER (is_impossible = 'respondido') * 100.0::double / count(*) AS answer_rate,
        count(*) FILTER (is_impossible = 'imposible') * 100.0::double / count(*) AS abstention_rate, count(*) FILTER (is_impossible = 'imposible' AND answer_text = 'RESPUESTA_NO_ENCONTRADA') AS consistent_sentinel,
        count(*) FILTER (qc_status = 'no_answer_free_text') AS free_text_no_answer, count(*) FILTER (qc_status = 'imposible_but_span_present') AS impossible_but_span_present FROM classified GROUP BY model""",
    label_crosstab=f"""WITH {KINDED} SELECT kind, round_even(count(*) FILTER (is_impossible = 'imposible') * 100.0::double / count(*), 1) AS imposible, round_even(count(*) FILTER (is_impossible = 'respondido') * 100.0::double / count(*), 1) AS respondido FROM with_kind GROUP BY kind""",
    word_stats=f"WITH {WORDED} SELECT lang, count(words) AS n, avg(words) AS mean, stddev_samp(words) AS std, min(words) AS min, " + ", ".join(f"quantile_cont(words, {p}) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + ", max(words) AS max FROM worded GROUP BY lang",
    price_quantiles="SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS p{round(p * 100)}" for p in (0.01, 0.25, 0.5, 0.75, 0.99)) + " FROM lineitem GROUP BY 1",
    word_population=f"""WITH {WORDED} SELECT lang, round_even(avg(words), 2) AS mean, round_even(stddev_pop(words), 2) AS std, min(words) AS min, round_even(quantile_cont(words, 0.25), 2) AS q1, round_even(quantile_cont(words, 0.5), 2) AS median,
        round_even(quantile_cont(words, 0.75), 2) AS q3, max(words) AS max FROM worded GROUP BY lang""",
    price_boxes="""WITH offs AS (SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, l_extendedprice * l_discount AS v FROM lineitem),
        boxes AS (SELECT flag, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM offs GROUP BY 1),
        met AS (SELECT *, q1 - 1.5::double * (q3 - q1) AS bottom, q3 + 1.5::double * (q3 - q1) AS top FROM (SELECT offs.flag, v, q1, median, q3 FROM offs JOIN boxes ON offs.flag IS NOT DISTINCT FROM boxes.flag))
        SELECT flag AS l_returnflag, count(*) AS n, round(least(min(v) FILTER (v >= bottom), q1), 4) AS low, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
            round(greatest(max(v) FILTER (v <= top), q3), 4) AS high, count(*) FILTER (v < bottom) AS below, count(*) FILTER (v > top) AS above FROM met GROUP BY flag, q1, median, q3""",
    word_histogram=f"""WITH {WORDED}, ends AS (SELECT min(words)::double AS low, max(words)::double AS high FROM worded)
        SELECT least(floor((words - low) * 50 / (high - low)) + 1, 50)::int AS bin, count(*) AS n FROM worded, ends GROUP BY 1""",
    overlong_p99=f"""WITH {classified()}, pos AS (SELECT model, question, {WORDS.format("answer_text")} AS aw, {WORDS.format("context")} AS cw FROM classified WHERE literal_match), lim AS (SELECT model, question, quantile_cont(aw, 0.99) AS p FROM pos GROUP BY 1, 2)
        SELECT model, question, round_even(p, 2) AS p99, count(*) AS positive_n, count(*) FILTER (aw > p) AS flagged_p99, count(*) FILTER (aw > 0.8 * cw) AS flagged_context, count(*) FILTER (aw > p AND aw > 0.8 * cw) AS flagged_combined FROM pos JOIN lim USING (model, question) GROUP BY model, question, p""",
    duplicated_answers=f"WITH {CANDIDATES} SELECT model, count(*) - count(DISTINCT answer_text) AS duplicates FROM candidates GROUP BY model",
    grouped_means="SELECT event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    pivot_metrics="SELECT day(ts)::bigint AS day, " + ", ".join(f"coalesce(avg(value) FILTER (event_type = '{t}'), 0) AS {t}" for t in ("click", "view", "purchase")) + " FROM events GROUP BY 1",
    unpivot_metrics="SELECT toxic::bigint AS toxic, 'quality' AS metric, avg(quality) AS value FROM labels GROUP BY 1 UNION ALL SELECT toxic::bigint, 'total', sum(quality)::double FROM labels GROUP BY 1",
    metric_table=f"""WITH {JUDGED} SELECT model, 200::bigint AS contexts_processed, 5::bigint AS questions_per_context, 1000::bigint AS expected_pairs, count(*) AS generated_pairs, round_even(count(*) * 100.0::double / 1000, 2) AS completeness, round_even(count(*) FILTER (is_impossible = 'respondido') * 100.0::double / count(*), 2) AS answer_rate,
        round_even(count(*) FILTER (is_impossible = 'imposible') * 100.0::double / count(*), 2) AS abstention_rate, round_even(count(*) FILTER (literal_match) * 100.0::double / count(*), 2) AS literal_span_valid, round_even(count(*) FILTER (offset_valid) * 100.0::double / count(*), 2) AS provided_offset_valid,
        round_even(count(*) FILTER (qc_status = 'non_extractive_or_hallucinated') * 100.0::double / count(*), 2) AS non_extractive, count(*) FILTER (is_impossible = 'imposible' AND answer_text <> 'RESPUESTA_NO_ENCONTRADA') AS inconsistent_sentinel,
        count(*) FILTER ({STRICT}) AS strict_n, count(*) FILTER ({EXPANDED}) AS expanded_n, count(*) FILTER (NOT {STRICT} AND NOT {EXPANDED}) AS uncertain_n, count(*) FILTER (flag) AS heuristic_flags,
        round_even(avg({WORDS.format("answer_text")}) FILTER (is_impossible = 'respondido'), 2) AS mean_answer_words FROM judged GROUP BY model""",
    best_epochs="SELECT event_type, event_id, user_id, floor(value)::bigint AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY floor(value) DESC, event_id) AS rn FROM events) WHERE rn = 1",
    probe_summary=f"""WITH p AS (SELECT 128 * (1 + doc_id % 3) AS max_new_tokens, doc_id % 5 > 0 AS ok, n_chars, {WORDS.format("text")}::bigint AS w FROM documents)
        SELECT max_new_tokens, count(*) AS total, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS errors, coalesce(max(n_chars) FILTER (ok), 0) AS max_chars, coalesce(max(w) FILTER (ok), 0) AS max_tokens FROM p GROUP BY 1""",
    benchmark_summary="""SELECT event_type AS model, count(*) AS num_samples, count(*) FILTER (event_id % 7 > 0) AS num_success, count(*) FILTER (event_id % 7 = 0) AS num_failures,
        round_even(avg(value) FILTER (event_id % 7 > 0), 3) AS avg_context_time_s, round_even(60.0::double / avg(value) FILTER (event_id % 7 > 0), 2) AS contexts_per_min FROM events GROUP BY 1""",
    experiment_plan="""WITH m AS (SELECT source AS model, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
        d AS (SELECT lang AS dataset, row_number() OVER (ORDER BY lang) - 1 AS j FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)), o(l, mode) AS (VALUES (0, 'zsl'), (1, 'ft')),
        runs AS (SELECT row_number() OVER (ORDER BY i, j, l) - 1 AS place, model, dataset, mode FROM m, d, o)
        SELECT place, model, dataset, mode, place % 4 AS slot FROM runs""",
    rows_per_key="SELECT n AS rows_per_key, count(*) AS n_keys FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY n",
    mode_deltas="SELECT event_type, avg(value) FILTER (user_id % 2 = 1) - avg(value) FILTER (user_id % 2 = 0) AS delta_value FROM events GROUP BY 1",
    normalized_texts=f"WITH {CONTEXTS} SELECT context_id, md5({BARE.format('context')}) AS bare, md5({COLLAPSE.format('context')}) AS low, length({STRIP.format('context')}) AS stripped FROM contexts",
    metric_tokens=f"WITH {CONTEXTS} SELECT context_id, len({TOKENS.format('context')})::bigint AS n_tokens, md5({ANSWER.format('context')}) AS plain FROM contexts",
    json_props="SELECT event_id, json_valid(props) AS valid, (props->>'k')::bigint AS k, props->>'page' AS page, props->>'ref' AS ref FROM events",
    json_repair="SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'w' || doc_id ELSE 'RESPUESTA_NO_ENCONTRADA' END AS answer_text, CASE WHEN doc_id % 4 < 3 THEN 'respondido' ELSE 'imposible' END AS is_impossible FROM documents",
    nested_flatten="""SELECT conv_id || '-' || turn AS id, md5(coalesce(text, '')) AS question, role = 'system' AS is_impossible, CASE WHEN role <> 'system' AND length(text) > 5 THEN substr(text, 1, 3) END AS answer,
        CASE WHEN role <> 'system' AND length(text) > 5 THEN 3 END::bigint AS answer_start FROM conversations""",
    token_windows=f"""WITH t AS (SELECT doc_id, {WORDS.format("text")}::bigint AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, greatest(n - 129, 0) + 1, 256)) AS first FROM t)
        SELECT doc_id, first // 256 AS window, first, least(384, n - first) AS n_tokens FROM w""",
    token_labels=f"""WITH {classified()}, s AS (SELECT context_id, k, start AS a, start + length(ans) AS e FROM classified WHERE model = 'a' AND literal_match)
        SELECT context_id, k::bigint AS k, (a // 10)::bigint AS start_token, ((e + 9) // 10 - 1)::bigint AS end_token FROM s""",
    top_positions="""WITH x AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings), r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) - 1 AS place FROM x)
        SELECT vec_id, place, i AS at FROM r WHERE place < 3""".replace(" AS at ", ' AS "at" '),
    run_names=f"""WITH {CONTEXTS}, p AS (SELECT *, 'out/model ' || doc_id % 3 || '/strict/zsl/' || context_id || '.csv' AS path FROM contexts), q AS (SELECT *, regexp_replace(path, '[^A-Za-z0-9._-]+', '_', 'g') AS plain FROM p)
        SELECT context_id, CASE WHEN length(plain) <= 40 THEN plain ELSE substr(plain, 1, 31) || '-' || substr(sha1(path), 1, 8) END AS name, 'model ' || doc_id % 3 AS model, 'strict' AS dataset, 'zsl' AS mode,
               md5('Contexto:' || chr(10) || context || chr(10) || chr(10) || 'Pregunta:' || chr(10) || '¿?' || chr(10) || chr(10) || 'Respuesta:') AS prompt FROM q""",
    word_spans=f"""WITH {classified()} SELECT context_id, model, k::bigint AS k, md5(substr(context, greatest(0, start - 120) + 1, start + length(ans) + 120 - greatest(0, start - 120))) AS around,
        substr(context, answer_start + 1, length(ans)) = ans AS at_given FROM classified WHERE literal_match""",
    event_windows="SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
    event_sessions="""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
        c AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    kappa="""WITH s AS (SELECT count(*) FILTER (quality = toxic)::double / count(*) AS seen, avg(quality) AS q, avg(toxic) AS t FROM labels) SELECT (seen - (q * t + (1 - q) * (1 - t))) / (1 - (q * t + (1 - q) * (1 - t))) AS kappa FROM s""",
    label_centroids="""WITH x AS (SELECT vec_id, label::bigint AS label, unnest(embedding)::double AS v, unnest(range(0, len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2)
        SELECT vec_id, label, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 9) AS cosine FROM x JOIN c USING (label, i) GROUP BY 1, 2""",
    pricing_rollup="SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    event_lags="""WITH l AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3.6e9 AS hours FROM events) SELECT user_id, round(min(hours), 6) AS least, round(avg(hours), 6) AS mean FROM l WHERE hours IS NOT NULL GROUP BY 1""",
)
LOGS = """logs AS (SELECT CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END AS model, CASE WHEN user_id % 3 = 0 THEN 'initial' ELSE 'resume_' || user_id % 2 END AS segment, event_id % 11 = 0 AS quiet, event_id % 90 + 10 AS done,
    (event_id % 3) * 3600 + 300 + user_id % 60 AS secs, event_id % 4 = 0 AS bad FROM events),
    parsed AS (SELECT model, segment, CASE WHEN quiet THEN 0 ELSE done END AS processed, CASE WHEN NOT quiet THEN secs END AS secs, (NOT quiet)::int AS fb, (NOT quiet AND bad)::int AS err, (NOT quiet AND NOT bad)::int AS ck FROM logs),
    segs AS (SELECT model, segment, count(*) AS workers, sum(processed)::bigint AS processed, sum(secs)::bigint AS elapsed_seconds, sum(fb)::bigint AS fallbacks, sum(err)::bigint AS critical_errors, sum(ck)::bigint AS checkpoints, sum(secs)::double / 3600 AS gpu_hours,
        sum(secs)::double / nullif(sum(processed), 0) AS seconds_per_context, max(secs)::double / 3600 AS wall_clock_hours,
        printf('%02d:%02d:%02d', max(secs) // 3600, max(secs) % 3600 // 60, max(secs) % 60) AS wall_clock FROM parsed GROUP BY 1, 2)"""
oracle(
    log_segments=f"WITH {LOGS} SELECT * FROM segs",
    growing_logs=f"WITH {LOGS} SELECT * FROM segs",
    log_models=f"WITH {LOGS} SELECT model, sum(processed)::bigint AS processed, sum(elapsed_seconds)::double / 3600 AS gpu_hours, sum(elapsed_seconds)::double / sum(processed) AS seconds_per_context, sum(elapsed_seconds)::double / greatest(max(workers), 1) / 3600 AS continuous_hours, printf('%02d:%02d:%02d', c // 3600, c % 3600 // 60, c % 60) AS continuous FROM (SELECT *, (sum(elapsed_seconds) OVER (PARTITION BY model) / max(workers) OVER (PARTITION BY model))::double AS whole, floor(whole)::bigint AS c FROM segs) GROUP BY model, c",
)
oracle(
    prepared_splits=f"""WITH {SCORED}, sizes AS (SELECT count(*) FILTER (h % 10 = 0) AS tests, count(*) FILTER (h % 10 = 1) AS ones, count(*) FILTER (h % 10 > 0) AS rest, round_even(count(*) * 0.1::double, 0)::bigint AS tenth FROM refs),
        devs AS (SELECT *, round_even(rest * (0.1::double / (1 - 0.1::double)), 0)::bigint AS d FROM sizes)
        SELECT 'two' AS given, 'test' AS split, tests AS n FROM devs UNION ALL SELECT 'two', 'validation', d FROM devs UNION ALL SELECT 'two', 'train', rest - d FROM devs
        UNION ALL SELECT 'three', 'test', tests FROM devs UNION ALL SELECT 'three', 'validation', ones FROM devs UNION ALL SELECT 'three', 'train', rest - ones FROM devs
        UNION ALL SELECT 'one', 'test', tenth FROM devs UNION ALL SELECT 'one', 'validation', tenth FROM devs UNION ALL SELECT 'one', 'train', tests + rest - 2 * tenth FROM devs""",
    generation_fallbacks=f"""WITH {CONTEXTS}, questions(question) AS (VALUES {", ".join(f"({quoted(q)})" for _, q in QUESTIONS)}), moods AS (
            SELECT context_id, question, ('0x' || substr(md5(context || '/' || question), 1, 1))::bigint AS mood, regexp_extract(context, '\\S+') AS word, strpos(context, regexp_extract(context, '\\S+')) - 1 AS start FROM contexts, questions)
        SELECT context_id, question, CASE WHEN mood < 4 THEN 'RESPUESTA_NO_ENCONTRADA' ELSE word END AS answer_text, CASE WHEN mood < 4 THEN 'imposible' ELSE 'respondido' END AS is_impossible,
               CASE WHEN mood < 4 THEN 0 ELSE start END::int AS answer_start, CASE WHEN mood < 4 THEN 0 ELSE start + length(word) END::int AS answer_end, mood < 4 AS impossible_find_answer,
               CASE WHEN mood < 4 THEN 3 WHEN mood < 8 THEN 2 ELSE 1 END::int AS attempts, CASE WHEN mood < 4 THEN 'RuntimeError: mood ' || mood END AS error FROM moods""",
    resumed_append=f"""WITH {CONTEXTS}, questions(k, question) AS (VALUES {", ".join(f"({k}, {quoted(q)})" for k, q in QUESTIONS)})
        SELECT context_id, k::bigint AS k, question, regexp_extract(context, '\\S+') AS answer_text FROM contexts, questions""",
    window_labels=f"""WITH {classified()}, runs AS (SELECT context_id, context, unnest(regexp_extract_all(context, '\\s*\\S+')) AS run, generate_subscripts(regexp_extract_all(context, '\\s*\\S+'), 1) - 1 AS i FROM contexts),
        words AS (SELECT context_id, i, e, e - length(ltrim(run, E' \\t\\n\\r\\f\\v')) AS b FROM (SELECT *, sum(length(run)) OVER (PARTITION BY context_id ORDER BY i)::bigint AS e FROM runs)),
        spans AS (SELECT context_id, k, start AS s, start + length(ans) AS t FROM classified WHERE model = 'a' AND start >= 0 AND is_impossible = 'respondido' AND ans <> 'RESPUESTA_NO_ENCONTRADA'),
        sizes AS (SELECT context_id, count(*) AS n FROM words GROUP BY 1), wide AS (SELECT context_id, k, s, t, unnest(range(0, greatest(n - 16, 0) // 25 + 1)) AS win FROM spans JOIN sizes USING (context_id)),
        met AS (SELECT d.context_id, k, win, s, t, max(CASE WHEN b <= s THEN i END) AS first, min(CASE WHEN e >= t THEN i END) AS last FROM wide d JOIN words w ON d.context_id = w.context_id AND i >= win * 25 AND i < win * 25 + 40 GROUP BY ALL)
        SELECT context_id, k::bigint AS k, win::bigint AS window, CASE WHEN first IS NULL OR last IS NULL OR t <= s THEN 0 ELSE first - win * 25 + 1 END::bigint AS start_token, CASE WHEN first IS NULL OR last IS NULL OR t <= s THEN 0 ELSE last - win * 25 + 1 END::bigint AS end_token FROM met""",
    generation_resume=f"WITH {CONTEXTS} SELECT context_id, regexp_extract(context, '\\S+') AS answer_text FROM contexts WHERE doc_id % 2 = 1",
)

FLAT = "CASE WHEN is_impossible <> 'imposible' AND start >= 0 THEN ans END AS answer, CASE WHEN is_impossible <> 'imposible' AND start >= 0 THEN start::int END AS answer_start"
RUNS = SCORED + """, runs AS (SELECT *, 'm' || (regexp_extract(id, '_(\\d+)_', 1)::bigint % 2) AS model, 'strict' AS dataset, CASE WHEN regexp_extract(id, '_(\\d+)_', 1)::bigint % 3 = 0 THEN 'zsl' ELSE 'ft' END AS mode,
    CASE WHEN score > 0 THEN blank ELSE em_kept END AS em, CASE WHEN score > 0 THEN blank ELSE f1_kept END AS f FROM scored)"""
LINES = (
    CANDIDATES
    + """, made AS (
    SELECT doc_id, k, h, doc_id % 3 AS worker, json_object('context_id', CASE WHEN h % 17 > 0 THEN context_id END, 'context', context, 'question', question, 'answer_text', answer_text, 'answer_start', answer_start,
        'answer_end', answer_start + length(ans), 'is_impossible', is_impossible)::varchar AS whole FROM candidates WHERE model = 'a'
), lines AS (SELECT *, h % 13 = 0 AS bad, CASE WHEN h % 13 = 0 THEN substr(whole, 1, 40) ELSE whole END AS line FROM made)"""
)
oracle(
    jsonl_round_trip=f"WITH {classified()} SELECT {RECORD_ID} AS id, context_id, md5(context) AS context, is_impossible = 'imposible' AS is_impossible, {FLAT} FROM classified",
    tolerant_shards=f"""WITH {LINES}, numbered AS (SELECT *, row_number() OVER line - 1 + coalesce(sum((h % 5 = 0)::int) OVER (line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_index FROM lines WINDOW line AS (PARTITION BY worker ORDER BY doc_id, k))
        SELECT worker, line_index::bigint AS line_index, md5(line) AS line FROM numbered WHERE bad UNION ALL SELECT NULL, count(*), 'good' FROM numbered WHERE NOT bad""",
    resumed_lines=f"""WITH {LINES}, done AS (SELECT context_id FROM lines JOIN candidates USING (doc_id, k, h) WHERE model = 'a' AND NOT bad AND h % 17 > 0 GROUP BY 1 HAVING count(*) = 5)
        SELECT md5(line) AS line, count(*) AS n FROM lines WHERE bad OR h % 17 = 0 OR ('context_' || doc_id) IN (SELECT context_id FROM done) GROUP BY 1""",
    audit_csv=f"""WITH {CANDIDATES} SELECT context_id || '-' || k AS row_id, md5(replace(context, ' t', ' "t,' || chr(10))) AS context, question, '-' || answer_text AS gold_answer, CASE WHEN is_impossible = 'imposible' THEN 'True' ELSE 'False' END AS gold_is_impossible FROM candidates WHERE model = 'b'""",
    narratives=f"SELECT copy, count(text) AS n, sum({WORDS.format('text')})::bigint AS words, max({WORDS.format('text')})::bigint AS longest FROM documents, (VALUES ('lines'), ('table')) c(copy) GROUP BY 1",
    experiment_files=f"""WITH {RUNS} SELECT 'metrics' AS part, model, dataset, mode, '' AS kind, round(avg(em), 9) AS exact, round(avg(f), 9) AS f1, count(*) AS total FROM runs GROUP BY ALL
        UNION ALL SELECT 'metrics_by_kind', model, dataset, mode, kind, round(avg(em), 9), round(avg(f), 9), count(*) FROM runs GROUP BY ALL
        UNION ALL SELECT 'gold', model, dataset, mode, '', round(avg(em), 9), round(avg(f), 9), count(*) FROM runs WHERE NOT impossible GROUP BY ALL
        UNION ALL SELECT 'predictions', '', '', '', '', 0.0::double, sum(length(prediction))::double, count(*) FROM runs""",
    completed_runs="SELECT model, 'strict' AS dataset, mode, model <> 'm2' AS completed FROM (VALUES ('m0'), ('m1'), ('m2')) a(model), (VALUES ('zsl'), ('ft')) b(mode)",
    log_files=f"WITH {LOGS} SELECT segment, sum(fallbacks)::bigint AS fallbacks, sum(critical_errors)::bigint AS critical_errors, sum(checkpoints)::bigint AS checkpoints FROM segs GROUP BY segment",
    json_documents="SELECT day(ts)::bigint AS day, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL",
    nested_files="""SELECT role = 'system' AS is_impossible, count(*) AS n, count(*) FILTER (role <> 'system' AND length(text) > 5) AS answered, sum(length(coalesce(text, '')))::bigint AS characters FROM conversations GROUP BY 1""",
    variant_files=ORACLES["record_errors"],
    split_files=f"""WITH {classified()} SELECT CASE WHEN model = 'a' THEN 'train' ELSE 'test' END AS split, is_impossible = 'imposible' AS is_impossible, count(*) AS n, count(*) FILTER (is_impossible <> 'imposible' AND start >= 0) AS answered, 'both' AS info FROM classified GROUP BY 1, 2""",
    picked_row=f"WITH {CONTEXTS} SELECT context_id, doc_id FROM contexts ORDER BY md5('7|' || context_id), context_id LIMIT 1",
    latex_table=f"""WITH {KINDED}, counted AS (SELECT kind, count(*) AS n, avg(answer_start) AS m, row_number() OVER (ORDER BY kind) AS place FROM with_kind GROUP BY kind)
        SELECT line::bigint AS line, value FROM (VALUES (0, '\\begin{{table}}'), (1, '\\caption{{Kinds & counts}}'), (2, '\\label{{tab:kinds}}'), (3, '\\begin{{tabular}}{{lll}}'), (4, '\\toprule'), (5, 'kind & n & mean\\_start \\\\'), (6, '\\midrule')) h(line, value)
        UNION ALL SELECT 6 + place, kind || ' & ' || n || ' & ' || printf('%.2f', m) || ' \\\\' FROM counted
        UNION ALL SELECT 6 + (SELECT count(*) FROM counted) + i, v FROM (VALUES (1, '\\bottomrule'), (2, '\\end{{tabular}}'), (3, '\\end{{table}}')) f(i, v)""",
)

#: The longest part that x and y share, of equals the first in x, then in y: a match of short texts, in which no character is common.
LONGEST = "list_max(list_filter(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(x) - i + 2), lambda n: {'n': n, 'i': -i}))), lambda m: contains(y, substr(x, -m.i, m.n))))"
GRAMS = "flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, len({0}) - n + 2), lambda i: array_to_string({0}[i : i + n - 1], ' '))))"
oracle(
    similarity_agreement=f"""WITH RECURSIVE {CANDIDATES}, rows AS (SELECT a.answer_text AS a, b.answer_text AS b, a.is_impossible = 'imposible' AS i, b.is_impossible = 'imposible' AS j
            FROM candidates a JOIN candidates b USING (context_id, question) WHERE a.model = 'a' AND b.model = 'b'),
        boxes AS (SELECT a, b, a AS x, b AS y, {LONGEST} AS m FROM (SELECT DISTINCT a, b, a AS x, b AS y FROM rows)
            UNION ALL SELECT a, b, x, y, {LONGEST} FROM (SELECT a, b, unnest([substr(x, 1, -m.i - 1), substr(x, -m.i + m.n)]) AS x, unnest([substr(y, 1, strpos(y, substr(x, -m.i, m.n)) - 1), substr(y, strpos(y, substr(x, -m.i, m.n)) + m.n)]) AS y
                FROM boxes WHERE m IS NOT NULL) WHERE x <> '' AND y <> ''),
        alike AS (SELECT a, b, CASE WHEN a = b THEN 1.0::double ELSE 2.0::double * coalesce(sum(m.n), 0)::double / (length(a) + length(b)) END AS ratio FROM boxes GROUP BY a, b)
        SELECT CASE WHEN i AND j THEN 'both_impossible' WHEN i <> j THEN 'disagree' WHEN ratio >= 0.7 THEN 'agree' ELSE 'disagree' END AS agreement, count(*) AS n FROM rows JOIN alike USING (a, b) GROUP BY 1""",
    bleu_scores=f"""WITH {SCORED}, words AS (SELECT id, regexp_extract_all(prediction, '\\S+') AS p, regexp_extract_all(coalesce(gold, ''), '\\S+') AS g FROM said),
        grams AS (SELECT id, {GRAMS.format("p")} AS p, {GRAMS.format("g")} AS g FROM words)
        SELECT id, CASE WHEN len(p) + len(g) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda y: y = t))))), 0)::double / greatest(len(p), len(g)) END::double AS bleu FROM grams""",
    decode_spans=f"""WITH {CONTEXTS}, wins AS (SELECT context_id AS id, context, length(context) AS size, unnest(range(0, greatest(ceil(length(context) / 95.0::double)::bigint - 2, 0) + 1)) AS w FROM contexts),
        placed AS (SELECT *, w * 95 + (i - CASE WHEN i < 20 THEN 1 ELSE 2 END) * 5 AS spot FROM (SELECT *, unnest(range(40)) AS i FROM wins)),
        tokens AS (SELECT id, context, w, i, CASE WHEN i IN (0, 20) OR spot >= size THEN 0 ELSE spot END AS b, CASE WHEN i IN (0, 20) OR spot >= size THEN 0 ELSE least(spot + 5, size) END AS e,
            ('0x' || substr(md5(concat_ws('/', id, w, i, 's')), 1, 6))::bigint::double / 1e6::double AS s, ('0x' || substr(md5(concat_ws('/', id, w, i, 'e')), 1, 6))::bigint::double / 1e6::double AS t FROM placed),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY id, w ORDER BY s DESC, i) AS s_at, row_number() OVER (PARTITION BY id, w ORDER BY t DESC, i) AS t_at FROM tokens),
        spans AS (SELECT a.id, a.w, a.i, z.i AS j, a.s + z.t AS score, substr(a.context, a.b + 1, z.e - a.b) AS text FROM ranked a JOIN ranked z ON a.id = z.id AND a.w = z.w AND z.i >= a.i AND z.i - a.i < 100
            WHERE a.s_at <= 20 AND z.t_at <= 20 AND a.e > a.b AND NOT (z.b = 0 AND z.e = 0)),
        best AS (SELECT * FROM spans WHERE {STRIP.format("text")} <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, w, i, j) = 1),
        nothing AS (SELECT id, min(s + t) AS score FROM tokens WHERE i = 0 GROUP BY id)
        SELECT id, coalesce(text, '') AS prediction_text, CASE WHEN best.score IS NULL THEN 'inf'::double ELSE nothing.score - best.score END AS no_answer_probability FROM nothing LEFT JOIN best USING (id)""",
)
