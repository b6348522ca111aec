"""The same results in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from gradeloom.operators.classifier import DEFAULT_BATCH, DEFAULT_EPOCHS, DEFAULT_RATE, RUNGS, STEP, Trial, draw_trials

# The stand-in tables of ``checks.tables``.
TABLES = {
    "corpus": """
        SELECT d.doc_id AS par_id, 'a' || d.doc_id AS art_id, d.source AS keyword, d.lang AS country_code, d.text,
               CAST(CASE WHEN l.toxic = 1 THEN 4 - l.quality WHEN l.quality = 0 THEN 2
                         ELSE CAST(l.doc_id % 13 >= 6 AS INT) END AS INT) AS label
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "all_list": "SELECT doc_id AS par_id, source AS label FROM documents",
    "gold_list": "SELECT doc_id AS par_id, CAST(quality AS VARCHAR) AS label FROM labels",
    "train_list": "SELECT doc_id AS par_id, source AS label FROM documents WHERE lang = 'en'",
    "dev_list": """
        SELECT l.doc_id AS par_id, CAST(l.quality AS VARCHAR) AS label
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.lang <> 'en'""",
    "augmented": """
        SELECT par_id, keyword AS label, 'bt ' || text AS text, 'bt' AS copy_no
        FROM corpus WHERE label > 1 AND country_code = 'en'""",
    "evaluated": """
        SELECT par_id, art_id, keyword, country_code, text, label AS graded,
               CASE WHEN label > 1 THEN 1 ELSE 0 END AS label,
               CASE WHEN (label > 1) = (par_id % 9 >= 2) THEN '1' ELSE '0' END AS prediction
        FROM corpus""",
    "merged_all": """
        SELECT a.par_id, c.text, c.label AS graded, c.keyword, CASE WHEN c.label > 1 THEN 1 ELSE 0 END AS label
        FROM all_list a LEFT JOIN corpus c ON a.par_id = c.par_id""",
    "both_lists": """
        SELECT s.par_id, c.keyword, CASE WHEN c.label > 1 THEN 1 ELSE 0 END AS label,
               length(coalesce(c.text, 'nan')) AS text_length,
               len(regexp_extract_all(coalesce(c.text, 'nan'), '{not_space}')) AS word_count
        FROM (SELECT par_id FROM train_list UNION ALL SELECT par_id FROM dev_list) s
        LEFT JOIN corpus c ON s.par_id = c.par_id""",
    "scores": """
        SELECT *, CASE WHEN logit_1 > logit_0 THEN 1 ELSE 0 END AS prediction FROM (
            SELECT vec_id AS row_idx, 'run-1' AS run_id, CASE WHEN label < 5 THEN 'valid' ELSE 'final' END AS split,
                   CAST(label > 4 AS INT) AS label,
                   CAST(list_max(list_filter(embedding, lambda x, i: i % 2 = 1)) AS DOUBLE) AS logit_0,
                   CAST(list_max(list_filter(embedding, lambda x, i: i % 2 = 0)) AS DOUBLE) AS logit_1
            FROM embeddings)""",
    "runs": """
        SELECT 'run-' || vec_id AS run_id, CASE WHEN label < 5 THEN 'valid' ELSE 'dev' END AS split,
               list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS f1
        FROM embeddings""",
    "words": """
        SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM documents""",
}

NOT_SPACE = (
    r"[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
TABLES["both_lists"] = TABLES["both_lists"].replace("{not_space}", NOT_SPACE)

# What each table is made of.
NEEDS = {
    "augmented": ["corpus"],
    "evaluated": ["corpus"],
    "merged_all": ["all_list", "corpus"],
    "both_lists": ["train_list", "dev_list", "corpus"],
}

ONE_LINE = "translate({}, chr(10) || chr(13) || chr(9), '   ')"
LENGTH_BUCKET = (
    "CASE WHEN {0} <= 128 THEN 1 WHEN {0} <= 256 THEN 2 WHEN {0} <= 384 THEN 3 WHEN {0} <= 512 THEN 4 ELSE 5 END"
)
BINS = "(VALUES (0, 128), (128, 256), (256, 384), (384, 512), (512, 1500)) bins(bin_left, bin_right)"


def with_tables(sql: str, *names: str) -> str:
    """Put the stand-in tables a query needs in front of it."""
    needed: list[str] = []
    for name in names:
        for part in (*NEEDS.get(name, []), name):
            if part not in needed:
                needed.append(part)
    parts = [f"{name} AS ({TABLES[name]})" for name in needed]
    body = sql.strip()
    if body.startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]])
    return f"WITH {', '.join(parts)} {body}" if parts else body


def cells(truth: str = "label = 1", untruth: str = "label = 0") -> str:
    return f"""
        count(*) FILTER (WHERE prediction = '1' AND {truth}) AS tp,
        count(*) FILTER (WHERE prediction = '0' AND {untruth}) AS tn,
        count(*) FILTER (WHERE prediction = '0' AND {truth}) AS fn,
        count(*) FILTER (WHERE prediction = '1' AND {untruth}) AS fp"""


def with_metrics(counts: str, keep: str) -> str:
    """Metrics over a query that has the four counts."""
    return f"""
        WITH counts AS ({counts}),
        rates AS (
            SELECT *, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS recall_,
                   CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS precision_,
                   CASE WHEN tp + tn + fn + fp = 0 THEN 0.0::DOUBLE
                        ELSE (tp + tn) / (tp + tn + fn + fp) END AS accuracy_
            FROM counts)
        SELECT {keep} tp, tn, fn, fp, round(recall_, 6) AS recall, round(precision_, 6) AS precision,
               round(CASE WHEN precision_ + recall_ = 0 THEN 0.0::DOUBLE
                          ELSE 2 * (precision_ * recall_) / (precision_ + recall_) END, 6) AS f1_score,
               round(accuracy_, 6) AS accuracy
        FROM rates"""


def _rank(seed: int, purpose: str, key: str) -> str:
    return f"md5('{seed}:{purpose}:' || {key})"


_ROW_KEY = "par_id || ':' || origin || ':' || copy_no"


def rebalanced(down: float, up: float) -> str:
    """Training rows after rebalancing, with their random position."""
    return f"""
        WITH train AS (
            SELECT t.par_id, CASE WHEN c.label > 1 THEN 1 ELSE 0 END AS label, 'orig' AS origin, '' AS copy_no
            FROM train_list t LEFT JOIN corpus c ON t.par_id = c.par_id),
        extra AS (
            SELECT a.par_id, CASE WHEN c.label > 1 THEN 1 ELSE 0 END AS label, 'aug' AS origin, a.copy_no
            FROM augmented a LEFT JOIN corpus c ON a.par_id = c.par_id),
        positives AS (SELECT count(*) AS p FROM train WHERE label = 1),
        added AS (
            SELECT *, row_number() OVER (ORDER BY {_rank(42, "up", _ROW_KEY)}) AS place FROM extra),
        kept AS (
            SELECT *, row_number() OVER (ORDER BY {_rank(42, "down", _ROW_KEY)}) AS place FROM train WHERE label = 0),
        mixed AS (
            SELECT par_id, label, origin, copy_no FROM train WHERE label = 1
            UNION ALL SELECT par_id, label, origin, copy_no FROM added
                WHERE place <= (SELECT trunc(p * {up}::DOUBLE - p) FROM positives)
            UNION ALL SELECT par_id, label, origin, copy_no FROM kept
                WHERE place <= (SELECT round_even(p * {down}::DOUBLE, 0) FROM positives)),
        rebalanced AS (
            SELECT *, row_number() OVER (ORDER BY {_rank(42, "shuffle", _ROW_KEY)}) - 1 AS row_idx FROM mixed)"""


def split_sides(down: float, up: float) -> str:
    return f"""{rebalanced(down, up)},
        drawn AS (
            SELECT *, row_number() OVER (ORDER BY {_rank(42, "split", _ROW_KEY)}) AS place,
                   round_even(0.8::DOUBLE * count(*) OVER (), 0) AS wanted
            FROM rebalanced),
        sides AS (
            SELECT par_id, label, origin, copy_no, row_idx, 'train' AS side FROM drawn WHERE place <= wanted
            UNION ALL
            SELECT par_id, label, origin, copy_no, row_idx, 'valid' AS side FROM rebalanced
            WHERE par_id NOT IN (SELECT par_id FROM drawn WHERE place <= wanted))"""


def _sample(n: str, seed: int = 42, purpose: str = "n") -> str:
    return f"""
        SELECT par_id, lang FROM (
            SELECT doc_id AS par_id, lang, row_number() OVER (ORDER BY {_rank(seed, purpose, "doc_id")}) AS place,
                   count(*) OVER () AS size
            FROM documents) WHERE place <= {n}"""


_KEYWORD_METRICS = with_metrics(f"SELECT keyword, count(*) AS n, {cells()} FROM evaluated GROUP BY keyword", "keyword, n,")
_COUNTRY_METRICS = with_metrics(f"SELECT country_code, {cells()} FROM evaluated GROUP BY country_code", "country_code,")

_VOCAB = """
    SELECT token, count(*) AS n FROM (SELECT unnest(words) AS token FROM words) GROUP BY token"""

_ENCODED = f"""
    WITH counted AS ({_VOCAB}),
        vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM counted),
        entries AS (SELECT doc_id, unnest(range(1, least(len(words), 512) + 1)) AS pos, words FROM words),
        ids AS (
            SELECT doc_id, string_agg(coalesce(id, 1), ',' ORDER BY pos) AS ids, count(*) AS n
            FROM entries LEFT JOIN vocab ON token = words[pos] GROUP BY doc_id)"""

_SENTENCE = r"string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1))"

_SPOKEN = rf"""
    SELECT par_id, i - 1 AS sent_no,
           regexp_extract_all(lower(sentences[i]), '[\p{{L}}\p{{N}}]+|[^ \t\n\r\f\x0B\p{{L}}\p{{N}}]') AS words
    FROM (SELECT *, unnest(range(1, len(sentences) + 1)) AS i FROM (
        SELECT doc_id AS par_id, {_SENTENCE} AS sentences FROM documents))"""

# Words up to five places apart, nearer ones with more weight.
_NEIGHBOURS = f"""
    spoken AS MATERIALIZED ({_SPOKEN}),
    neighbours AS MATERIALIZED (
        SELECT least(words[i], words[i + k]) AS a, greatest(words[i], words[i + k]) AS b, CAST(sum(6 - k) AS BIGINT) AS n
        FROM (SELECT words, unnest(range(1, len(words) + 1)) AS i FROM spoken), (SELECT unnest(range(1, 6)) AS k)
        WHERE i + k <= len(words) GROUP BY 1, 2)"""

# Log ratios to chance in steps of 2**-20, each in one of 100 dimensions by the MD5 of the neighbour.
_VECTORS = f"""
    {_NEIGHBOURS},
    directed AS (
        SELECT a AS word, b AS near, CASE WHEN a = b THEN 2 * n ELSE n END AS n FROM neighbours
        UNION ALL SELECT b, a, n FROM neighbours WHERE a <> b),
    sums AS (SELECT word, CAST(sum(n) AS DOUBLE) AS total FROM directed GROUP BY word),
    signed AS (
        SELECT d.word, CAST('0x' || substr(md5(d.near), 1, 8) AS BIGINT) % 100 AS place,
               CASE WHEN substr(md5(d.near), 9, 1) < '8' THEN 1 ELSE -1 END
               * CAST(round(ln(n * (SELECT sum(total) FROM sums) / (s.total * r.total)) * 1048576) AS BIGINT) AS steps
        FROM directed d JOIN sums s ON s.word = d.word JOIN sums r ON r.word = d.near
        WHERE n * (SELECT sum(total) FROM sums) / (s.total * r.total) > 1),
    entries AS (
        SELECT word, map_from_entries(list(struct_pack(k := CAST(place AS INT), v := CAST(steps AS DOUBLE)))) AS entries
        FROM (SELECT word, place, sum(steps) AS steps FROM signed GROUP BY word, place) GROUP BY word),
    counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM spoken) GROUP BY word),
    vectors AS (
        SELECT c.word, n, list_transform(range(100), lambda x: coalesce(entries[CAST(x AS INT)], 0) / 1048576) AS vector
        FROM counts c LEFT JOIN entries e ON e.word = c.word)"""


def _sides() -> str:
    """Labelled documents to train on and to validate with."""
    return f"""
        drawn AS (
            SELECT par_id, text, label, row_number() OVER (ORDER BY {_rank(42, "split", "par_id")}) AS place,
                   round_even(0.8::DOUBLE * count(*) OVER (), 0) AS wanted
            FROM evaluated),
        sides AS (
            SELECT CASE WHEN place <= wanted THEN 'train' ELSE 'valid' END AS side, par_id, label, text FROM drawn
            UNION ALL
            SELECT 'dev', d.par_id, CASE WHEN c.label > 1 THEN 1 ELSE 0 END, c.text
            FROM dev_list d LEFT JOIN corpus c ON c.par_id = d.par_id
            UNION ALL SELECT 'all', doc_id, NULL, text FROM documents),
        spelled AS (
            SELECT side, par_id, label, regexp_extract_all(lower(coalesce(text, 'nan')), '[\\p{{L}}\\p{{N}}]+') AS words
            FROM sides),
        features AS MATERIALIZED (
            SELECT side, par_id, label, feature, sqrt(count(*)::DOUBLE / any_value(len(words))) AS value
            FROM (SELECT side, par_id, label, words, unnest(words) AS feature FROM spelled)
            GROUP BY side, par_id, label, feature
            UNION ALL SELECT side, par_id, label, '', 1.0 FROM spelled)"""


def _said(side: str, weights: str) -> str:
    """Margins of the rows of one side by all trials of a table of weights."""
    return f"""
        SELECT t.trial, f.par_id, f.label, round(sum(f.value * coalesce(w.weight, 0)), 9) AS margin
        FROM (SELECT * FROM features WHERE side = '{side}') f
        CROSS JOIN (SELECT DISTINCT trial FROM {weights}) t
        LEFT JOIN {weights} w ON w.trial = t.trial AND w.feature = f.feature
        GROUP BY t.trial, f.par_id, f.label"""


def _measured(margins: str) -> str:
    rates = f"""
        SELECT trial, avg(-ln(greatest(CASE WHEN label = 1 THEN 1 / (1 + exp(-margin)) ELSE 1 - 1 / (1 + exp(-margin)) END, 1e-15)))
                   AS loss,
               count(*) FILTER (WHERE margin > 0 AND label = 1) AS tp, count(*) FILTER (WHERE margin > 0 AND label = 0) AS fp,
               count(*) FILTER (WHERE margin <= 0 AND label = 1) AS fn, count(*) AS n
        FROM ({margins}) GROUP BY trial"""
    return f"""
        SELECT trial, loss, (n - fp - fn) / n AS accuracy,
               CASE WHEN tp = 0 THEN 0.0::DOUBLE
                    ELSE 2 * ((tp / (tp + fp)) * (tp / (tp + fn))) / (tp / (tp + fp) + tp / (tp + fn)) END AS f1
        FROM ({rates})"""


def trained(trials: Sequence[Trial], rungs: Sequence[int] = ()) -> str:
    """Tables of the training of all trials: ``log``, ``chosen`` (weights of the best epoch) and ``reached``."""
    rows = ", ".join(f"({i}, {t.learning_rate!r}::DOUBLE, {t.batch_size}, {t.epochs})" for i, t in enumerate(trials))
    prior = """
        prior AS (
            SELECT count(*)::DOUBLE AS n, round(ln(avg(label) / (1 - avg(label))), 9) AS b FROM spelled WHERE side = 'train')"""
    parts = [_sides(), prior, f"trials(trial, rate, batch_size, epochs) AS (VALUES {rows})", "going_1 AS (SELECT * FROM trials)"]
    last = max(t.epochs for t in trials)
    for epoch in range(1, last + 1):
        if epoch == 1:
            said = "SELECT trial, par_id, label, b AS margin FROM going_1, prior, (SELECT * FROM spelled WHERE side = 'train')"
            before, joined = "CASE WHEN g.feature = '' THEN b ELSE 0 END", ""
        else:
            said = f"SELECT * FROM ({_said('train', f'weights_{epoch - 1}')}) JOIN going_{epoch} USING (trial)"
            before, joined = "w.weight", f"JOIN weights_{epoch - 1} w ON w.trial = g.trial AND w.feature = g.feature"
        parts.append(f"""
            weights_{epoch} AS MATERIALIZED (
                SELECT g.trial, g.feature,
                       round({before} - t.rate * {STEP!r} * pow(ln(r.n / g.n) / ln(r.n), 2) / greatest(g.n, t.batch_size) * g.slope, 9)
                           AS weight
                FROM (
                    SELECT m.trial, f.feature, count(*) AS n, sum(f.value * (1 / (1 + exp(-m.margin)) - m.label)) AS slope
                    FROM ({said}) m JOIN features f ON f.side = 'train' AND f.par_id = m.par_id
                    GROUP BY m.trial, f.feature) g
                JOIN trials t ON t.trial = g.trial {joined}, prior r)""")
        parts.append(f"log_{epoch} AS MATERIALIZED ({_measured(_said('valid', f'weights_{epoch}'))})")
        median = f"f1 >= (SELECT median(f1) FROM log_{epoch}) AND" if epoch in rungs else ""
        parts.append(f"going_{epoch + 1} AS (SELECT t.* FROM trials t JOIN log_{epoch} l USING (trial) WHERE {median} t.epochs > {epoch})")
    parts.append("log AS (" + " UNION ALL ".join(f"SELECT {e} AS epoch, * FROM log_{e}" for e in range(1, last + 1)) + ")")
    parts.append("best AS (SELECT trial, arg_min(epoch, (loss, epoch)) AS epoch, max(epoch) AS epochs_run FROM log GROUP BY trial)")
    every = " UNION ALL ".join(f"SELECT {e} AS epoch, * FROM weights_{e}" for e in range(1, last + 1))
    parts.append(f"chosen AS MATERIALIZED (SELECT trial, feature, weight FROM ({every}) JOIN best USING (trial, epoch))")
    return ", ".join(parts)


def single(epochs: int = DEFAULT_EPOCHS) -> str:
    return trained([Trial("single", DEFAULT_RATE, DEFAULT_BATCH, epochs)])


ORACLE: dict[str, str] = {
    "a1_read_corpus": with_tables(
        f"SELECT par_id, art_id, keyword, country_code, {ONE_LINE.format('text')} AS text, label FROM corpus", "corpus"
    ),
    "a1_read_corpus_consume": with_tables(
        f"""SELECT par_id, art_id, keyword, country_code, {ONE_LINE.format('text')} AS text, label FROM corpus
            WHERE par_id > (SELECT min(par_id) FROM corpus)""",
        "corpus",
    ),
    "a2_read_split_labels": with_tables(
        "SELECT row_number() OVER (ORDER BY par_id) - 1 AS row_idx, par_id, label FROM gold_list", "gold_list"
    ),
    "a3_read_unlabelled": f"SELECT CAST(doc_id AS VARCHAR) AS par_id, {ONE_LINE.format('text')} AS text FROM documents",
    "a3_read_unlabelled_in_order": f"""
        SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, CAST(doc_id AS VARCHAR) AS par_id,
               {ONE_LINE.format('text')} AS text
        FROM documents""",
    "a4_read_augmented": """
        SELECT doc_id AS par_id, CASE WHEN lang = 'en' THEN source END AS label, text, 'aug' AS origin FROM documents""",
    "a5_read_indexed_lines": with_tables(
        """SELECT row_number() OVER (ORDER BY par_id) - 1 AS row_idx, CAST(prediction AS INT) AS value
           FROM evaluated""",
        "evaluated",
    ),
    "a6_read_training_log": """
        SELECT vec_id AS run_id, CAST(i - 1 AS INT) AS pos, CAST(i AS DOUBLE) AS epoch,
               CAST(embedding[i] AS DOUBLE) AS eval_accuracy, abs(CAST(embedding[i] AS DOUBLE)) AS eval_f1
        FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "a6_read_training_log_arrays": """
        SELECT vec_id AS run_id, CAST(i - 1 AS INT) AS pos, CAST(i AS DOUBLE) AS epoch,
               CAST(embedding[i] AS DOUBLE) AS eval_accuracy, abs(CAST(embedding[i] AS DOUBLE)) AS eval_f1
        FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "a7_write_label_lines": with_tables(
        "SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, prediction AS value FROM scores", "scores"
    ),
    "a8_write_augmented": with_tables("SELECT par_id, label, text, 'aug' AS origin FROM augmented", "augmented"),
    "a9_read_scores": with_tables("SELECT run_id, split, row_idx, logit_0, logit_1 FROM scores", "scores"),
    "b1_resolve_label_columns": with_tables(
        """SELECT d.doc_id AS par_id, CASE WHEN d.lang <> 'fr' THEN 'own ' || d.text END AS text, c.keyword, c.label
           FROM documents d LEFT JOIN corpus c ON d.doc_id = c.par_id""",
        "corpus",
    ),
    "b2_binarize": with_tables("SELECT par_id, label FROM merged_all", "merged_all"),
    "b3_graded_label": with_tables("SELECT par_id, label FROM corpus", "corpus"),
    "b4_filter_class": with_tables("SELECT par_id, keyword, label FROM evaluated WHERE label = 1", "evaluated"),
    "b5_text_length": "SELECT doc_id AS par_id, CAST(length(text) AS INT) AS text_length FROM documents",
    "b6_word_count": f"""
        SELECT doc_id AS par_id, CAST(len(regexp_extract_all(text, '{NOT_SPACE}')) AS INT) AS word_count FROM documents""",
    "b7_length_bucket": f"SELECT doc_id AS par_id, {LENGTH_BUCKET.format('length(text)')} AS bucket FROM documents",
    "b8_cut": f"""
        SELECT doc_id AS par_id, bin_left, bin_right
        FROM documents LEFT JOIN {BINS} ON length(text) > bin_left AND length(text) <= bin_right""",
    "b9_bin_label": f"""
        SELECT bin_left || ' - ' || bin_right AS bin, min(length(text)) || '-' || max(length(text)) AS observed
        FROM documents LEFT JOIN {BINS} ON length(text) > bin_left AND length(text) <= bin_right GROUP BY bin_left, bin_right""",
    "b10_graded_positive": with_tables("SELECT par_id, label > 2 AS positive FROM corpus", "corpus"),
    "b11_text_or_nan": with_tables("SELECT par_id, coalesce(text, 'nan') AS text FROM merged_all", "merged_all"),
    "b12_argmax": """
        SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS class FROM embeddings""",
    "b13_every_nth": """
        SELECT vec_id, CAST(i / 3 AS INT) AS pos, CAST(embedding[i + 2] AS DOUBLE) AS value
        FROM (SELECT *, unnest(range(0, len(embedding) - 1, 3)) AS i FROM embeddings)""",
    "b14_log_series": """
        SELECT vec_id AS run_id, CAST(i / 3 AS INT) AS pos, CAST(i + 2 AS DOUBLE) AS epoch,
               CAST(embedding[i + 2] AS DOUBLE) AS eval_accuracy, abs(CAST(embedding[i + 2] AS DOUBLE)) AS eval_f1
        FROM (SELECT *, unnest(range(0, len(embedding) - 1, 3)) AS i FROM embeddings)""",
    "b15_normalise_text": "SELECT doc_id AS par_id, lower(replace(text, chr(10), ' ')) AS text FROM documents",
    "b16_preview": with_tables(
        "SELECT par_id AS row_idx, keyword, prediction FROM evaluated WHERE graded = 2 ORDER BY par_id LIMIT 5",
        "evaluated",
    ),
    "b17_prediction_as_string": with_tables("SELECT par_id, prediction FROM evaluated", "evaluated"),
    "c1_merge_with_labels": with_tables("SELECT par_id, text, label FROM merged_all", "merged_all"),
    "c1_merge_with_both_labels": with_tables("SELECT par_id, keyword, text, label, graded FROM evaluated", "evaluated"),
    "c2_label_augmented": with_tables(
        """SELECT a.par_id, a.text, a.copy_no, CASE WHEN c.label > 1 THEN 1 ELSE 0 END AS label
           FROM augmented a LEFT JOIN corpus c ON a.par_id = c.par_id""",
        "augmented",
    ),
    "c3_attach_by_position": with_tables(
        "SELECT row_number() OVER (ORDER BY par_id) - 1 AS row_idx, par_id, prediction FROM evaluated", "evaluated"
    ),
    "c4_anti_join_by_key": """
        SELECT doc_id AS par_id, source AS label FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "c3_attach_fanned_out": with_tables(
        """SELECT row_number() OVER (ORDER BY par_id, copy) - 1 AS row_idx, par_id,
                  CAST((par_id + copy) % 2 AS VARCHAR) AS prediction
           FROM (SELECT par_id, unnest(range(1, CASE WHEN par_id % 4 = 0 THEN 3 ELSE 2 END)) AS copy FROM corpus)""",
        "corpus",
    ),
    "c4_anti_join_null_keys": """
        SELECT doc_id AS par_id, source AS label FROM documents
        WHERE doc_id % 3 > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""",
    "c5_vector_pairs": """
        SELECT x.vec_id AS a, CAST(x.label AS BIGINT) AS b,
               round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS similarity
        FROM embeddings x JOIN embeddings y ON y.vec_id = x.label""",
    "d1_confusion_counts": with_tables(f"SELECT {cells()} FROM evaluated", "evaluated"),
    "d2_confusion_counts_graded": with_tables(
        f"SELECT keyword, {cells('graded > 2', 'graded <= 2')} FROM evaluated GROUP BY keyword", "evaluated"
    ),
    "d3_classification_metrics": with_tables(_COUNTRY_METRICS, "evaluated"),
    "d4_metrics_by_length": with_tables(
        with_metrics(
            f"""SELECT bucket, count(par_id) AS n, CAST(min(length(text)) AS INT) AS min_length,
                       CAST(max(length(text)) AS INT) AS max_length, {cells()}
                FROM (VALUES (1), (2), (3), (4), (5)) buckets(bucket)
                LEFT JOIN evaluated ON bucket = {LENGTH_BUCKET.format('length(text)')} GROUP BY bucket""",
            "bucket, n, min_length, max_length,",
        ),
        "evaluated",
    ),
    "d5_metrics_by_graded_label": with_tables(
        with_metrics(
            f"""SELECT grade AS label, count(par_id) AS n, {cells('graded > 1', 'graded <= 1')}
                FROM (VALUES (0), (1), (2), (3), (4)) grades(grade)
                LEFT JOIN evaluated ON grade = graded GROUP BY grade""",
            "label, n,",
        ),
        "evaluated",
    ),
    "d6_metrics_by_keyword": with_tables(_KEYWORD_METRICS, "evaluated"),
    "d7_class_counts": with_tables("SELECT label, count(*) AS n FROM merged_all GROUP BY label", "merged_all"),
    "d8_positive_rate_by_bin": with_tables(
        f"""SELECT bin_left, bin_right, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1,
                   round(100 * n1 / nullif(n0 + n1, 0), 6) AS ratio
            FROM {BINS} LEFT JOIN both_lists ON text_length > bin_left AND text_length <= bin_right
            GROUP BY bin_left, bin_right""",
        "both_lists",
    ),
    "d9_keyword_counts": with_tables(
        "SELECT keyword, count(*) AS n FROM both_lists WHERE keyword IS NOT NULL GROUP BY keyword", "both_lists"
    ),
    "d10_keyword_label_pivot": with_tables(
        "SELECT keyword, "
        + ", ".join(f"count(*) FILTER (WHERE label = {g}) AS label_{g}" for g in range(5))
        + " FROM corpus GROUP BY keyword",
        "corpus",
    ),
    "d10_keyword_label_pivot_all_labels": with_tables(
        "SELECT keyword, "
        + ", ".join(f"count(*) FILTER (WHERE label * 2 = {g}) AS label_{g}" for g in (0, 1, 2, 3, 4, 6, 8))
        + " FROM corpus GROUP BY keyword",
        "corpus",
    ),
    "d11_histogram_by_class": with_tables(
        """WITH span AS (SELECT min(word_count) AS lo, max(word_count) AS hi FROM both_lists)
           SELECT CAST(least(floor((word_count - lo) * 40.0::DOUBLE / (hi - lo)) + 1, 40) AS INT) AS bin, label, count(*) AS n
           FROM both_lists, span GROUP BY 1, 2""",
        "both_lists",
    ),
    "d11_histogram_all_bins": with_tables(
        """WITH span AS (SELECT min(word_count)::DOUBLE AS lo, max(word_count)::DOUBLE AS hi FROM both_lists),
           counts AS (
               SELECT CAST(least(floor((word_count - lo) * 40.0::DOUBLE / (hi - lo)) + 1, 40) AS INT) AS bin, label, count(*) AS n
               FROM both_lists, span GROUP BY 1, 2)
           SELECT CAST(b.bin AS INT) AS bin, CAST(c.label AS INT) AS label, coalesce(n, 0) AS n,
                  round(lo + (hi - lo) * (b.bin - 1) / 40, 6) AS bin_left, round(lo + (hi - lo) * b.bin / 40, 6) AS bin_right
           FROM (SELECT unnest(range(1, 41)) AS bin) b CROSS JOIN (SELECT unnest([0, 1]) AS label) c CROSS JOIN span
           LEFT JOIN counts ON counts.bin = b.bin AND counts.label = c.label""",
        "both_lists",
    ),
    "flow_data_report": with_tables(
        f"""WITH span AS (SELECT min(word_count)::DOUBLE AS lo, max(word_count)::DOUBLE AS hi FROM both_lists),
           binned AS (
               SELECT bin_left, bin_right, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1
               FROM {BINS} LEFT JOIN both_lists ON text_length > bin_left AND text_length <= bin_right GROUP BY 1, 2),
           trained AS (
               SELECT c.keyword, c.label FROM train_list t JOIN corpus c ON c.par_id = t.par_id WHERE c.keyword IS NOT NULL)
           SELECT 'classes' AS report, 'all' AS key, label::VARCHAR AS part, count(*)::DOUBLE AS value FROM both_lists GROUP BY label
           UNION ALL
           SELECT 'positive_rate', bin_left || ' - ' || bin_right, '1',
                  CASE WHEN n0 + n1 > 0 THEN round(100 * n1::DOUBLE / (n0 + n1), 6) END FROM binned
           UNION ALL
           SELECT 'word_counts', b.bin::VARCHAR, c.label::VARCHAR, coalesce(n, 0)::DOUBLE
           FROM (SELECT unnest(range(1, 41)) AS bin) b CROSS JOIN (SELECT unnest([0, 1]) AS label) c
           LEFT JOIN (
               SELECT least(floor((word_count - lo) * 40.0::DOUBLE / (hi - lo)) + 1, 40) AS bin, label, count(*) AS n
               FROM both_lists, span GROUP BY 1, 2) h ON h.bin = b.bin AND h.label = c.label
           UNION ALL
           SELECT 'keywords', keyword, 'all', count(*)::DOUBLE FROM both_lists WHERE keyword IS NOT NULL GROUP BY keyword
           UNION ALL
           SELECT 'grades', k.keyword, g.grade::VARCHAR, (SELECT count(*) FROM trained t WHERE t.keyword = k.keyword AND t.label = g.grade)::DOUBLE
           FROM (SELECT DISTINCT keyword FROM trained) k CROSS JOIN (SELECT unnest(range(0, 5)) AS grade) g""",
        "both_lists",
    ),
    "d12_confusion_matrix": with_tables(
        """SELECT label, count(*) FILTER (WHERE prediction = '0') AS predicted_0,
                  count(*) FILTER (WHERE prediction = '1') AS predicted_1
           FROM evaluated GROUP BY label""",
        "evaluated",
    ),
    "d13_evaluate_scores": with_tables(
        with_metrics(
            f"""SELECT split, {cells()} FROM (
                    SELECT split, label, CAST(prediction AS VARCHAR) AS prediction FROM scores) GROUP BY split""",
            "split,",
        ),
        "scores",
    ),
    "d14_select_runs": with_tables("SELECT * FROM runs WHERE f1 > 0.35 AND split = 'dev'", "runs"),
    "d14_best_run": with_tables("SELECT * FROM runs ORDER BY f1 DESC, run_id LIMIT 1", "runs"),
    "e1_sample_n": _sample("150"),
    "e2_sample_n_or_fail": _sample("190", seed=7),
    "e3_sample_frac": _sample("round_even(0.35::DOUBLE * size, 0)", purpose="frac"),
    "e4_shuffle_rows": f"""
        SELECT doc_id AS par_id, lang, row_number() OVER (ORDER BY {_rank(42, "shuffle", "doc_id")}) - 1 AS row_idx
        FROM documents""",
    "e5_rebalance": with_tables(f"{rebalanced(3, 2.5)} SELECT * FROM rebalanced".strip(), "train_list", "augmented"),
    "e5_rebalance_partly_augmented": with_tables(
        f"{rebalanced(2, 1.5)} SELECT * FROM rebalanced".strip(), "train_list", "augmented"
    ),
    "e6_split_train_valid": with_tables(f"{split_sides(3, 2.5)} SELECT * FROM sides", "train_list", "augmented"),
    "e6_split_by_id": with_tables(
        f"""{rebalanced(3, 2.5)},
            ids AS (
                SELECT par_id, count(*) AS size, {_rank(42, "split_id", "par_id")} AS hash FROM rebalanced GROUP BY par_id),
            placed AS (
                SELECT par_id, size, coalesce(sum(size) OVER (ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                           AS before, round_even(0.8::DOUBLE * sum(size) OVER (), 0) AS wanted
                FROM ids)
            SELECT r.par_id, r.label, r.origin, r.copy_no, r.row_idx,
                   CASE WHEN before < wanted AND 2 * (wanted - before) >= size THEN 'train' ELSE 'valid' END AS side
            FROM rebalanced r JOIN placed USING (par_id)""",
        "train_list",
        "augmented",
    ),
    "e7_concat": with_tables(
        """SELECT par_id, label, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS copy_no FROM train_list
           UNION ALL SELECT par_id, label, NULL, NULL FROM dev_list
           UNION ALL SELECT par_id, label, text, copy_no FROM augmented""",
        "train_list",
        "dev_list",
        "augmented",
    ),
    "e8_sort_by_metric": with_tables(f"{_COUNTRY_METRICS} ORDER BY accuracy DESC, country_code", "evaluated"),
    "f1_encode_tokens": with_tables(
        f"""{_ENCODED}
            SELECT d.doc_id AS par_id,
                   substr(coalesce(',' || ids, '') || repeat(',0', 512 - coalesce(n, 0)), 2) AS input_ids,
                   substr(repeat(',1', coalesce(n, 0)) || repeat(',0', 512 - coalesce(n, 0)), 2) AS attention_mask
            FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id""",
        "words",
    ),
    "f1_encode_repeated_ids": with_tables(
        f"""{_ENCODED}
            SELECT nullif(d.doc_id % 7, 0) AS par_id, md5(text) AS text_md5,
                   substr(coalesce(',' || ids, '') || repeat(',0', 512 - coalesce(n, 0)), 2) AS input_ids
            FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id""",
        "words",
    ),
    "f2_build_vocab": with_tables(
        f"""SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INT) AS id
            FROM ({_VOCAB}) WHERE n >= 2""",
        "words",
    ),
    "f3_sentences_of_words": rf"""
        SELECT par_id, CAST(i - 1 AS INT) AS sent_no, array_to_string(words, ' ') AS words FROM (
            SELECT par_id, i,
                   regexp_extract_all(lower(sentences[i]), '[\p{{L}}\p{{N}}]+|[^ \t\n\r\f\x0B\p{{L}}\p{{N}}]') AS words
            FROM (SELECT *, unnest(range(1, len(sentences) + 1)) AS i FROM (
                SELECT doc_id AS par_id, {_SENTENCE} AS sentences FROM documents)))
        WHERE len(words) > 0""",
    "f3_learn_abbreviations": r"""
        WITH found AS (
            SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*\.?')) AS token FROM documents),
        counts AS (
            SELECT rtrim(token, '.') AS word, count(*) AS n, count(*) FILTER (WHERE token LIKE '%.') AS n_stops FROM found GROUP BY 1),
        shares AS (SELECT greatest(least(sum(n_stops) / sum(n), 1 - 1e-9::DOUBLE), 1e-9::DOUBLE) AS p FROM counts),
        scored AS (
            SELECT word, n, n_stops, length(replace(word, '.', '')) AS letters, n - n_stops AS without,
                   2 * (n_stops * ln(0.99::DOUBLE) + (n - n_stops) * ln(1 - 0.99::DOUBLE)
                        - n_stops * ln(p) - (n - n_stops) * ln(1 - p)) AS ratio
            FROM counts, shares WHERE n_stops > 0)
        SELECT word, n, n_stops,
               round(ratio * exp(-letters::DOUBLE) * (length(word) - letters + 1) * pow(letters::DOUBLE, -without::DOUBLE), 6)
                   + 0.0::DOUBLE AS score
        FROM scored""",
    "f4_count_neighbours": f"WITH {_NEIGHBOURS} SELECT * FROM neighbours",
    "f4_train_word_vectors": f"""
        WITH {_VECTORS}
        SELECT word, n, array_to_string(list_transform(vector, lambda x: CAST(round(x * 1e6) AS BIGINT)), ',') AS vector
        FROM vectors""",
    "f6_train_text_classifier": with_tables(
        f"""WITH {single()}
            SELECT CAST(epoch AS INT) AS epoch, round(loss, 6) AS eval_loss, round(f1, 6) AS eval_f1,
                   round(accuracy, 6) AS eval_accuracy
            FROM log""",
        "evaluated",
        "dev_list",
    ),
    "f7_score": with_tables(
        f"""WITH {single(2)}
            SELECT par_id AS row_idx, round(margin, 6) AS margin, CAST(margin > 0 AS INT) AS prediction
            FROM ({_said("all", "chosen")})""",
        "evaluated",
        "dev_list",
    ),
    "f8_search_hyperparameters": with_tables(
        f"""WITH {trained(draw_trials(), RUNGS)}
            SELECT 'run-' || trial AS run_id, round(rate * 1e5, 6) AS learning_rate, CAST(batch_size AS INT) AS batch_size,
                   CAST(epochs AS INT) AS epochs, CAST(epochs_run AS INT) AS epochs_run, split, round(f1, 6) AS f1,
                   round(accuracy, 6) AS accuracy
            FROM (
                SELECT trial, 'valid' AS split, f1, accuracy FROM log JOIN best USING (trial, epoch)
                UNION ALL SELECT trial, 'dev', f1, accuracy FROM ({_measured(_said("dev", "chosen"))}))
            JOIN trials USING (trial) JOIN (SELECT trial, epochs_run FROM best) USING (trial)""",
        "evaluated",
        "dev_list",
    ),
    "f11_save_and_load_model": with_tables(
        f"""WITH {single(1)}
            SELECT par_id, round(margin, 6) AS margin, CAST(margin > 0 AS INT) AS prediction
            FROM ({_said("valid", "chosen")})""",
        "evaluated",
        "dev_list",
    ),
    "flow_single_run": with_tables(
        f"""WITH {single(2)}
            SELECT 'run-1' AS run_id, split, par_id AS row_idx, CAST(label AS INT) AS label, round(margin, 6) AS margin,
                   round(f1, 6) AS dev_f1, round(accuracy, 6) AS dev_accuracy
            FROM (
                SELECT 'valid' AS split, par_id, label, margin FROM ({_said("dev", "chosen")})
                UNION ALL SELECT 'final', par_id, NULL, margin FROM ({_said("all", "chosen")})),
            (SELECT f1, accuracy FROM ({_measured(_said("dev", "chosen"))}))""",
        "evaluated",
        "dev_list",
    ),
    "flow_word_similarity": f"""
        WITH {_VECTORS},
            tokens AS (
                SELECT token, count(*) AS n FROM (
                    SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM documents)
                GROUP BY token HAVING count(*) >= 5),
            leaders AS (
                SELECT length(token) AS n_chars, arg_min(token, (-n, token)) AS b FROM tokens GROUP BY 1)
        SELECT token AS a, b, round(CASE WHEN list_dot_product(x.vector, x.vector) * list_dot_product(y.vector, y.vector) > 0
                                         THEN list_cosine_similarity(x.vector, y.vector) END, 6) AS similarity
        FROM tokens JOIN leaders ON n_chars = length(token)
        JOIN vectors x ON x.word = token JOIN vectors y ON y.word = b""",
    "f5_cosine": """
        SELECT x.vec_id,
               round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS similarity
        FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""",
    "f7_score_with": """
        SELECT doc_id AS row_idx, CAST(length(text) AS DOUBLE) AS logit_1, CAST(length(text) > 1000 AS INT) AS prediction
        FROM documents""",
    "f10_augment_text": with_tables(
        """SELECT par_id, label, 'bt ' || text AS text, 'aug' AS origin, 'bt' AS copy_no, CAST(NULL AS VARCHAR) AS error
           FROM evaluated""",
        "evaluated",
    ),
    "f10_augment_text_once": """
        SELECT doc_id AS par_id, 'aug' AS origin, 'bt' AS copy_no, CAST(NULL AS VARCHAR) AS error,
               md5(CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) THEN 'bt ' ELSE 'again ' END || text)
                   AS text_md5
        FROM documents""",
    "f9_evaluate_baseline": with_tables(
        with_metrics(
            f"""SELECT 'guess' AS scorer, {cells()} FROM (
                    SELECT label, CASE WHEN substr({_rank(42, "score", "par_id")}, 1, 1) >= '8'
                                       THEN '1' ELSE '0' END AS prediction FROM evaluated)
                UNION ALL
                SELECT 'constant' AS scorer, {cells()} FROM (SELECT label, '0' AS prediction FROM evaluated)""",
            "scorer,",
        ),
        "evaluated",
    ),
    "flow_metrics_by_keyword": with_tables(_KEYWORD_METRICS, "evaluated"),
    "flow_error_slices": with_tables(
        with_metrics(
            f"""SELECT slice, value, CAST(sum(n) AS BIGINT) AS n, min(min_length) AS min_length, max(max_length) AS max_length,
                       CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn,
                       CAST(sum(fp) AS BIGINT) AS fp
                FROM (
                    SELECT CASE g WHEN 7 THEN 'all' WHEN 3 THEN 'length' WHEN 5 THEN 'grade' ELSE 'keyword' END AS slice,
                           CASE g WHEN 7 THEN 'all' WHEN 3 THEN bucket::VARCHAR WHEN 5 THEN graded::VARCHAR
                                  ELSE keyword END AS value, n, min_length, max_length, tp, tn, fn, fp
                    FROM (
                        SELECT grouping_id(bucket, graded, keyword) AS g, bucket, graded, keyword, count(*) AS n,
                               CAST(min(text_length) AS INT) AS min_length, CAST(max(text_length) AS INT) AS max_length,
                               {cells()}
                        FROM (SELECT *, length(text) AS text_length, {LENGTH_BUCKET.format('length(text)')} AS bucket
                              FROM evaluated)
                        GROUP BY GROUPING SETS ((), (bucket), (graded), (keyword)))
                    UNION ALL SELECT 'length', unnest(range(1, 6))::VARCHAR, 0, NULL, NULL, 0, 0, 0, 0
                    UNION ALL SELECT 'grade', unnest(range(0, 5))::VARCHAR, 0, NULL, NULL, 0, 0, 0, 0)
                GROUP BY slice, value""",
            "slice, value, n, min_length, max_length,",
        ),
        "evaluated",
    ),
    "flow_training_sets": with_tables(
        f"""{split_sides(3, 2.5)}
            SELECT s.*, CASE WHEN s.origin = 'aug' THEN a.text ELSE c.text END AS text
            FROM sides s LEFT JOIN corpus c ON s.par_id = c.par_id
            LEFT JOIN augmented a ON s.par_id = a.par_id""",
        "train_list",
        "augmented",
    ),
    "flow_augmented_training": with_tables(
        """SELECT a.par_id, 'aug' AS origin, 'bt' AS copy_no, CASE WHEN c.label > 1 THEN 1 ELSE 0 END AS label,
                  md5('bt ' || a.text) AS text_md5
           FROM evaluated a
           JOIN (SELECT par_id, label FROM corpus UNION ALL SELECT par_id, label FROM corpus WHERE par_id % 4 = 0) c
             ON a.par_id = c.par_id
           WHERE length(a.text) % 5 <> 0""",
        "corpus",
        "evaluated",
    ),
    "flow_rewritten_scores": with_tables("SELECT run_id, split, row_idx, logit_0, logit_1 FROM scores", "scores"),
    "flow_label_files": with_tables(
        """SELECT row_number() OVER (PARTITION BY split ORDER BY row_idx) - 1 AS row_idx, prediction AS value, split
           FROM scores""",
        "scores",
    ),
}
