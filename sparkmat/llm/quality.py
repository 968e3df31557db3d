"""Quality rules by distribution divergence, in DataFrame and SQL functions only.

A document's histogram of character classes, and that of the common words of
its language, are compared with the language's references by the Jensen-Shannon
divergence (base 2, so from 0 to 1).  A reference is the mean histogram of all
documents of the language that pass the base rules and are long enough; there
is one for each language of COMMON_WORDS, and one of character classes for all
other documents.  A divergence counts only from a least length on, as short
histograms are noise.

Words of the base figures are runs of characters other than white space
``[\\x20\\x09-\\x0D]``.  Repeated three-word windows are found by sorting 64-bit
hashes with positions inside each row: nothing is exploded or shuffled, and a
frequent word or window loads no task.  (Two windows of one text with equal
hashes count as equal: about 1e-10 for a text of 100,000 words.)

Cases: a null or empty text has no words, all figures 0, and fails the base
rules; a null or unknown lang is held against the reference of all other
documents (no common words); without any reference (empty table) only the base
rules apply; columns of the documents with the names of added figures are
replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.llm.common import packed, table, unpacked, write_table

#: Frequent function words of each language (lower case).
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"],
}
#: Runs taken out of the text one after another; what is left at the end is the last class.
CLASSES = ["[a-z]+", "[A-Z]+", r"[\x20\x09-\x0D]+", r"[\p{L}\p{M}]+", "[0-9]+", r"[.,;:!?'\x22()\x2D]+"]
MIN_WORDS = 50
MAX_CLASS_DIVERGENCE = 0.05
MAX_WORD_DIVERGENCE = 0.07
#: Guards: characters and words from which on a divergence counts.
MIN_CLASS_CHARS = 200
MIN_COMMON_WORDS = 100
SPACE = r"[\\x20\\x09-\\x0D]"
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_divergence", "word_divergence", "kept"]


def _sql_list(values: list[str]) -> str:
    return "array(" + ", ".join("'" + v + "'" for v in values) + ")"


def _lang(known: dict) -> str:
    return "CASE WHEN lang IN (" + ", ".join(f"'{k}'" for k in known) + ") THEN lang ELSE '' END"


def with_base_figures(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    lines = F.expr(rf"filter(split(_text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')")
    hashes = "IF(size(_words) < 3, array(), transform(sequence(0, size(_words) - 3), k -> xxhash64(_words[k], _words[k + 1], _words[k + 2])))"
    repeated = """
      IF(size(_hashes) = size(array_distinct(_hashes)), 0,
        aggregate(
          transform(array(sort_array(transform(_hashes, (h, k) -> struct(h AS h, k AS k)))), s ->
            sort_array(array_distinct(flatten(transform(
              filter(sequence(1, size(s) - 1), k -> s[k].h = s[k - 1].h),
              k -> array(s[k - 1].k, s[k].k))))))[0],
          struct(0 AS n, 0 AS until),
          (a, p) -> struct(a.n + 3 - greatest(0, a.until - p) AS n, p + 3 AS until),
          a -> a.n))
    """
    return (
        docs.drop(*FIGURES)
        .withColumn("_text", F.expr("coalesce(text, '')"))
        .withColumns({"_words": F.expr(f"array_remove(split(_text, '{SPACE}+'), '')"), "_lines": lines})
        .withColumn("_hashes", F.expr(hashes))
        .withColumns({
            "n_words": F.expr("CAST(size(_words) AS bigint)"),
            "word_chars": F.expr("CAST(length(array_join(_words, '')) AS bigint)"),
            "n_symbols": F.expr("CAST(length(regexp_replace(_text, '[^#*$%&|<>]+', '')) AS bigint)"),
            "n_dup_lines": F.expr("CAST(size(_lines) - size(array_distinct(_lines)) AS bigint)"),
            "n_repeat_words": F.expr(f"CAST({repeated} AS bigint)"),
        })
        .withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"))
        .drop("_lines", "_hashes", "_words")
    )


def _with_histograms(docs: DataFrame) -> DataFrame:
    """_classes and _common: shares, as arrays of double; null under the guards.  Needs _text."""
    df = docs.withColumn("_left0", F.col("_text"))
    for k, pattern in enumerate(CLASSES):
        df = df.withColumn(f"_left{k + 1}", F.regexp_replace(f"_left{k}", pattern, ""))
    last = len(CLASSES)
    counts = [F.length(f"_left{k}") - F.length(f"_left{k + 1}") for k in range(last)] + [F.length(f"_left{last}")]
    every = sorted({w for own in COMMON_WORDS.values() for w in own})
    lists = "map(" + ", ".join(f"'{k}', {_sql_list(v)}" for k, v in COMMON_WORDS.items()) + ")"
    within = ", ".join(f"'{w}'" for w in every)
    shares = f"""
      IF(_lang = '' OR size(_tokens) < {MIN_COMMON_WORDS}, NULL,
        transform(array(filter(_tokens, w -> w IN ({within}))), few ->
          transform(array(transform(element_at({lists}, _lang), w -> size(few) - size(array_remove(few, w)))), n ->
            transform(concat(n, array(size(_tokens) - aggregate(n, 0, (a, b) -> a + b))), x -> x / CAST(size(_tokens) AS double)))[0])[0])
    """
    return (
        df.withColumn("_counts", F.array(*counts))
        .withColumns({
            "_lang": F.expr(_lang(COMMON_WORDS)),
            "_tokens": F.expr(r"array_remove(split(lower(_text), '[^\\p{L}\\p{M}]+'), '')"),
            "_classes": F.expr(f"IF(length(_text) < {MIN_CLASS_CHARS}, NULL, transform(_counts, x -> x / CAST(length(_text) AS double)))"),
        })
        .withColumn("_common", F.expr(shares))
        .drop("_counts", "_tokens", *(f"_left{k}" for k in range(last + 1)))
    )


def with_figures(docs: DataFrame) -> DataFrame:
    """The base figures and the histograms, in one pass over the texts; ``fit_references`` and ``verdict`` take this."""
    return _with_histograms(with_base_figures(docs)).drop("_text")


def fit_references(figures: DataFrame) -> dict[str, dict[str, list[float] | None]]:
    """The references by language, '' for all others: at most one row for each entry of COMMON_WORDS and one more come to the driver."""
    n_classes, n_words = len(CLASSES) + 1, max(map(len, COMMON_WORDS.values())) + 1
    means = [F.avg(F.get("_classes", F.lit(k))).alias(f"c{k}") for k in range(n_classes)] + [F.avg(F.get("_common", F.lit(k))).alias(f"w{k}") for k in range(n_words)]
    out = {}
    for row in figures.where("NOT base_failed").groupBy("_lang").agg(*means).collect():
        classes, words = [row[f"c{k}"] for k in range(n_classes)], [row[f"w{k}"] for k in range(n_words)]
        words = [w for w in words if w is not None]
        out[row["_lang"]] = {"classes": None if classes[0] is None else classes, "words": words or None}
    return out


def _divergence(own: str, reference: str) -> str:
    term = "IF({x} > 0, 0.5D * {x} * log2(2 * {x} / (p + q)), 0D)"
    return f"IF({own} IS NULL OR {reference} IS NULL, NULL, aggregate(zip_with({own}, {reference}, (p, q) -> {term.format(x='p')} + {term.format(x='q')}), 0D, (a, b) -> a + b))"


def _references_sql(references: dict, kind: str) -> str:
    cases = "".join(
        f" WHEN '{lang}' THEN array(" + ", ".join(f"{x!r}D" for x in own[kind]) + ")" for lang, own in references.items() if own[kind]
    )
    return f"CASE _lang{cases} END" if cases else "CAST(NULL AS array<double>)"


def verdict(figures: DataFrame, references: dict) -> DataFrame:
    """The divergences, and ``kept``: false for what the base rules or a divergence reject."""
    return (
        figures.withColumns({"_ref_classes": F.expr(_references_sql(references, "classes")), "_ref_common": F.expr(_references_sql(references, "words"))})
        .withColumns({
            "class_divergence": F.expr(_divergence("_classes", "_ref_classes")),
            "word_divergence": F.expr(_divergence("_common", "_ref_common")),
        })
        .withColumn("kept", F.expr(f"NOT base_failed AND coalesce(class_divergence, 0D) <= {MAX_CLASS_DIVERGENCE}D AND coalesce(word_divergence, 0D) <= {MAX_WORD_DIVERGENCE}D"))
        .drop("_lang", "_classes", "_common", "_ref_classes", "_ref_common")
    )


def judge(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` (text, lang and any other columns) with the columns FIGURES.

    The figures are written into the shared folder, with the texts unless
    ``keep_text`` is false, so that the texts are gone through once.  Columns of
    ``docs`` named like a figure are replaced, all others come out as they are,
    whatever their names.
    """
    docs = docs.drop(*FIGURES)
    left_out = () if keep_text else ("text",)
    figures = with_figures(packed(docs, ["text", "lang"], left_out)).drop("text", "lang")
    figures = write_table(figures, "figures")
    return verdict(figures, fit_references(figures)).select(*unpacked([c for c in docs.columns if c not in left_out]), *FIGURES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    space, quoted = r"[\x20\x09-\x0D]", lambda own: ", ".join(f"'{w}'" for w in own)
    left, counts = "t", []
    for pattern in CLASSES:
        quoted_pattern = pattern.replace("'", "''")
        shorter = f"regexp_replace({left}, '{quoted_pattern}', '', 'g')"
        counts.append(f"length({left}) - length({shorter})")
        left = shorter
    lists = " ".join(f"WHEN '{k}' THEN [{quoted(v)}]" for k, v in COMMON_WORDS.items())
    term = "CASE WHEN {x} > 0 THEN 0.5 * {x} * log2(2 * {x} / (p + q)) ELSE 0 END"

    def divergence(own: str, reference: str) -> str:
        return f"""(SELECT sum({term.format(x="p")} + {term.format(x="q")})
            FROM (SELECT unnest({own}) AS p, unnest({reference}) AS q))"""

    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         CASE WHEN lang IN ({quoted(COMMON_WORDS)}) THEN lang ELSE '' END AS lg
  FROM documents
), w AS (
  SELECT rid, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), grams AS (
  SELECT rid, k, count(*) OVER (PARTITION BY rid, ws[k], ws[k + 1], ws[k + 2]) AS n
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS k FROM w WHERE len(ws) >= 3)
), covered AS (
  SELECT rid, count(DISTINCT k + o) AS n FROM grams, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY rid
), figures AS (
  SELECT d.rid, doc_id, lg, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN length(t) >= {MIN_CLASS_CHARS}
           THEN list_transform([{", ".join(counts)}, length({left})], lambda x: x / length(t)::DOUBLE) END AS classes,
         list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{M}}]+'), lambda x: x <> '') AS tokens,
         CASE lg {lists} END AS listed
  FROM d JOIN w ON w.rid = d.rid LEFT JOIN covered ON covered.rid = d.rid
), counted AS (
  SELECT rid, list(n ORDER BY k) AS ns FROM (
    SELECT rid, k, len(list_filter(tokens, lambda x: x = word)) AS n
    FROM (SELECT rid, tokens, unnest(listed) AS word, unnest(range(len(listed))) AS k FROM figures
          WHERE lg <> '' AND len(tokens) >= {MIN_COMMON_WORDS})) GROUP BY rid
), hist AS (
  SELECT f.*, CASE WHEN ns IS NOT NULL THEN
           list_transform(list_append(ns, len(tokens) - list_sum(ns)::BIGINT), lambda x: x / len(tokens)::DOUBLE) END AS common
  FROM figures f LEFT JOIN counted ON counted.rid = f.rid
), ref_classes AS (
  SELECT lg, list(m ORDER BY k) AS q FROM (SELECT lg, k, avg(x) AS m FROM (
    SELECT lg, unnest(classes) AS x, unnest(range(len(classes))) AS k FROM hist WHERE NOT base_failed) GROUP BY lg, k) GROUP BY lg
), ref_common AS (
  SELECT lg, list(m ORDER BY k) AS q FROM (SELECT lg, k, avg(x) AS m FROM (
    SELECT lg, unnest(common) AS x, unnest(range(len(common))) AS k FROM hist WHERE NOT base_failed) GROUP BY lg, k) GROUP BY lg
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({divergence("classes", "rc.q")}, 0) <= {MAX_CLASS_DIVERGENCE}
         AND coalesce({divergence("common", "rw.q")}, 0) <= {MAX_WORD_DIVERGENCE} AS kept
FROM hist LEFT JOIN ref_classes rc ON rc.lg = hist.lg LEFT JOIN ref_common rw ON rw.lg = hist.lg
"""


OP3_SQL = _oracle()
