"""The registered queries of the search and ranking engine, and the SQL that each must equal.

Catalogs over the driver's tables: parts as files and applications, pages as a path tree, events as opens and file events,
embeddings as vectors, suppliers as installed software. Each query runs over its whole table; limits are top-k features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fuzzy, scalars
from quarry.functions import text as T
from quarry.operators import catalog, channels, evaluation, history, merge, search, segments, store, usage, vectors
from quarry.plans import shared, staged
from quarry.sources import listings
from quarry.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1706659200
ASKED = [(1, "red widget"), (2, "wid"), (3, "rw"), (4, "blue"), (5, "widgte"), (6, "gizmo 12"), (7, "hotp"), (8, "promo"), (9, "redwidget_12.promo"), (10, "colda"), (11, "larg"), (12, "anvli"), (13, "/parts/Brand#7/RedRod_7.promo")]


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _asked(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or ASKED, "query_id int, text string")


def _values(rows) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in rows) + ") q(query_id, text)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files: /parts/<brand>/<RedWidget_12.promo>."""
    w = F.split("p_name", " ")
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 100))
    path = F.concat(F.lit("/parts/"), "p_brand", F.lit("/"), cap(w[0]), cap(w[1]), F.lit("_"), F.col("p_size").cast("string"), F.lit("."), F.lower("p_type"))
    return catalog.entries(_t(spark, d, "part"), F.col("p_partkey"), path)


def _cap(x: str) -> str:
    return f"upper({x}[1]) || substr({x}, 2)"


PARTS = f"""parts AS (SELECT entry_id, '/parts/' || p_brand || '/' || name AS path, name, lower(name) AS norm, p_brand, p_type, p_name FROM (
  SELECT p_partkey AS entry_id, p_brand, p_type, p_name, {_cap("split_part(p_name, ' ', 1)")} || {_cap("split_part(p_name, ' ', 2)")} || '_' || p_size || '.' || lower(p_type) AS name FROM part))"""


def _tok(x: str) -> str:
    for a, b in (("([a-z])([A-Z])", ""), ("([A-Z])([A-Z][a-z])", ""), ("([A-Za-z])([0-9])", ""), ("([0-9])([A-Za-z])", "")):
        x = f"regexp_replace({x}, '{a}', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex({x}, '[/_\\-. \\t\\n\\r]+'), lambda t: t <> '')"


TOKENS = f"toks AS (SELECT entry_id, name, norm, path, list_transform({_tok('name')}, lambda t: lower(t)) AS t FROM parts)"
KEYS = """keys AS (SELECT DISTINCT entry_id, key, score, complete FROM (
  SELECT entry_id, norm AS key, 6000 AS score, 0 AS complete FROM toks
  UNION ALL SELECT entry_id, array_to_string(list_transform(t, lambda x: x[1]), ''), 4500, 0 FROM toks
  UNION ALL SELECT entry_id, unnest(t), unnest(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i = 1 THEN 6000 ELSE 5000 END)), 128 FROM toks) WHERE key <> '')"""


def _words(rows=None) -> str:
    return f"""words AS (SELECT query_id, text, unnest(w) AS word, unnest(range(0, len(w))) AS pos, len(w) AS n_words FROM (
      SELECT query_id, text, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM {_values(rows or ASKED)}))"""


PREFIX = """hits AS (SELECT query_id, pos, entry_id, max(score + CASE WHEN key = word THEN complete ELSE 0 END) AS score
  FROM words JOIN keys ON starts_with(key, word) WHERE NOT contains(word, '/') GROUP BY ALL)"""
TOTALS = """totals AS (SELECT query_id, entry_id, sum(s) AS total FROM (SELECT query_id, pos, entry_id, max(score) AS s FROM hits GROUP BY ALL) GROUP BY ALL
  HAVING count(*) = (SELECT max(n_words) FROM words w WHERE w.query_id = any_value(query_id)))"""
NEED = "need AS (SELECT query_id, max(n_words) AS need FROM words GROUP BY ALL)"
TOTALS = """totals AS (SELECT query_id, entry_id, total FROM (SELECT query_id, entry_id, sum(s) AS total, count(*) AS m FROM (SELECT query_id, pos, entry_id, max(score) AS s FROM hits GROUP BY ALL) GROUP BY ALL) JOIN need USING (query_id) WHERE m = need)"""


def _final(limit: int) -> str:
    return f"""SELECT * FROM (SELECT query_id, entry_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, entry_id) AS rank FROM (
      SELECT query_id, entry_id, path, CAST(CASE WHEN text[1] = '/' AND text = path THEN 20000000 WHEN norm = trim(lower(text)) THEN 10000000 ELSE greatest(1, total + greatest(0, 64 - length(norm))) END AS BIGINT) AS score
      FROM (SELECT query_id, entry_id, total FROM totals UNION ALL SELECT query_id, entry_id, 0 FROM {_values(ASKED)} JOIN parts ON text = path) JOIN parts USING (entry_id) JOIN {_values(ASKED)} USING (query_id)))
      WHERE rank <= {limit}"""


# --- text and retrieval ------------------------------------------------------------------------------------


@query(f"WITH {PARTS}, {TOKENS} SELECT entry_id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens, array_to_string(list_transform(t, lambda x: x[1]), '') AS initials FROM toks")
def lex_tokens(spark, d):
    t = T.tokens(F.col("name"))
    return parts(spark, d).select("entry_id", F.size(t).alias("n_tokens"), F.array_join(t, "|").alias("tokens"), T.initials(F.col("name")).alias("initials"))


@query(f"WITH {PARTS}, {TOKENS}, {KEYS} SELECT * FROM keys")
def lex_prefix_keys(spark, d):
    return channels.prefix_keys(parts(spark, d))


@query(f"WITH {PARTS}, {TOKENS}, {KEYS}, {_words()}, {PREFIX} SELECT * FROM hits")
def lex_prefix_hits(spark, d):
    return channels.prefix_hits(channels.query_words(_asked(spark)), channels.prefix_keys(parts(spark, d)))


@query(f"WITH {PARTS}, {TOKENS}, {KEYS}, {_words()}, {PREFIX}, {NEED}, {TOTALS} {_final(10)}")
def lex_prefix_topk(spark, d):
    items, asked = parts(spark, d), _asked(spark)
    words = channels.query_words(asked)
    totals = search.combined(words, channels.prefix_hits(words, channels.prefix_keys(items)))
    return search.ranked(search.scored(totals, asked, items))


@query(f"""WITH {PARTS}, c AS (SELECT DISTINCT norm, unnest(string_split(norm, '')) AS c FROM parts),
  b AS (SELECT norm, CASE WHEN c BETWEEN 'a' AND 'z' THEN ascii(c) - 97 WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 22 ELSE 36 + ((CAST(unicode(c) AS HUGEINT) * 2654435761 % 4294967296) // 65536) % 28 END AS bit, count(*) AS n FROM c GROUP BY ALL)
  SELECT norm, CAST(bit_or(1::BIGINT << CAST(bit AS INT)) AS BIGINT) AS mask FROM b GROUP BY ALL""")
def lex_mask(spark, d):
    return parts(spark, d).select("norm").distinct().select("norm", T.mask(F.col("norm")).alias("mask"))


@query(f"WITH {PARTS} SELECT entry_id, CAST(coalesce(bit_or(1::BIGINT << CAST(ascii(c) - 97 AS INT)), 0) AS BIGINT) AS letters FROM (SELECT DISTINCT entry_id, unnest(string_split(lower(path), '')) AS c FROM parts) WHERE c BETWEEN 'a' AND 'z' GROUP BY ALL")
def lex_context_mask(spark, d):
    return parts(spark, d).select("entry_id", catalog.context_mask(F.lower("path")).bitwiseAND(F.lit((1 << 26) - 1)).alias("letters"))


@query(f"WITH {PARTS} SELECT norm, CAST(coalesce(bit_or(1::BIGINT << CAST(ascii(c) - 97 AS INT)), 0) AS BIGINT) AS letters FROM (SELECT DISTINCT norm FROM parts) LEFT JOIN (SELECT norm, c FROM (SELECT norm, i, norm[i] AS c FROM (SELECT norm, unnest(range(1, length(norm) + 1)) AS i FROM (SELECT DISTINCT norm FROM parts))) WHERE c BETWEEN 'a' AND 'z' GROUP BY ALL HAVING count(*) > 1) USING (norm) GROUP BY ALL")
def lex_repeat_mask(spark, d):
    return parts(spark, d).select("norm").distinct().select("norm", T.repeat_mask(F.col("norm")).bitwiseAND(F.lit((1 << 26) - 1)).alias("letters"))


def _symbols(out: str, table: str, raw: str, norm: str) -> str:
    """CTE out (norm, i, c, b): the symbols of the texts, and whether a token starts there."""
    return f"""{out}_pos AS (SELECT DISTINCT {raw} AS r, {norm} AS n, unnest(range(0, length({raw}))) AS i FROM {table}),
  {out} AS (SELECT n AS norm, i, substr(n, i + 1, 1) AS c, max(CASE WHEN i = 0 OR regexp_matches(substr(r, i, 1), '[/_\\-. ]') OR regexp_matches(substr(r, i, 2), '[a-z][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]') OR regexp_matches(substr(r, i, 3), '^[A-Z][A-Z][a-z]') THEN 1 ELSE 0 END) AS b FROM {out}_pos GROUP BY ALL)"""


def _aligned(out: str, words: str, sym: str, longest: int, first: bool = False) -> str:
    """CTE out (word, norm, s): the score of each word in each text by its best alignment (first: by the first one)."""
    gain = "x.s + 16 + 32 * y.b + CASE WHEN y.i = x.i + 1 THEN 24 ELSE -least(y.i - x.i - 1, 64) END"
    start = "SELECT word, s.norm, min(s.i) AS i, arg_min(272 + 32 * s.b - least(s.i, 64), s.i) AS s" if first else "SELECT word, s.norm, s.i, 272 + 32 * s.b - least(s.i, 64) AS s"
    steps = [f"{out}1 AS ({start} FROM (SELECT DISTINCT word FROM {words}) JOIN {sym} s ON s.c = word[1]{' GROUP BY word, s.norm' if first else ''})"]
    for q in range(2, longest + 1):
        pick = f"min(y.i) AS i, arg_min({gain}, y.i) AS s" if first else f"y.i, max({gain}) AS s"
        steps.append(f"{out}{q} AS (SELECT x.word, x.norm, {pick} FROM {out}{q - 1} x JOIN {sym} y ON y.norm = x.norm AND y.c = x.word[{q}] AND y.i > x.i GROUP BY {'x.word, x.norm' if first else 'x.word, x.norm, y.i'})")
    every = " UNION ALL ".join(f"SELECT word, norm, s FROM {out}{q} WHERE length(word) = {q}" for q in range(1, longest + 1))
    return ", ".join(steps) + f", {out} AS (SELECT word, norm, CAST(max(greatest(1, s)) AS INT) AS s FROM ({every}) GROUP BY word, norm)"


SYM = _symbols("sym", "parts", "name", "norm")
PLAIN = "plain AS (SELECT * FROM words WHERE NOT contains(word, '/'))"
LONGEST = max(len(w) for _, t in ASKED for w in t.split() if "/" not in w)
ALIGNED = _aligned("al", "plain", "sym", LONGEST)


@query(f"WITH {PARTS}, {_words()}, {PLAIN}, {SYM}, {ALIGNED} SELECT query_id, pos, entry_id, s + 1500 AS score FROM plain JOIN al USING (word) JOIN parts USING (norm)")
def lex_subsequence(spark, d):
    return channels.subsequence_hits(channels.query_words(_asked(spark)), parts(spark, d))


@query(f"WITH {PARTS}, {_words()}, {PLAIN}, {SYM}, {ALIGNED} SELECT word, norm, s AS score FROM al")
def lex_optimal_score(spark, d):
    words = channels.query_words(_asked(spark)).where("NOT contains(word, '/')").select("word").distinct()
    met = parts(spark, d).select("norm", "starts").distinct().join(F.broadcast(words), T.holds(F.col("norm"), F.col("word")))
    return met.select("word", "norm", fuzzy.optimal(F.col("norm"), F.col("starts"), F.col("word")).alias("score"))


@query(f"WITH {PARTS}, {_words()}, {PLAIN}, {SYM}, {_aligned('al', 'plain', 'sym', LONGEST, first=True)} SELECT word, norm, s AS score FROM al")
def lex_greedy_score(spark, d):
    words = channels.query_words(_asked(spark)).where("NOT contains(word, '/')").select("word").distinct()
    met = parts(spark, d).select("norm", "starts").distinct().join(F.broadcast(words), T.holds(F.col("norm"), F.col("word")))
    return met.select("word", "norm", fuzzy.greedy(F.col("norm"), F.col("starts"), F.col("word")).alias("score"))


PATH_ASKED = [(1, "br/red"), (2, "/7/hotrod"), (3, "parts/brand#1/"), (4, "b1/w")]
PATHS = "slashed AS (SELECT * FROM words WHERE contains(word, '/'))"


def _paths(rows) -> str:
    return f"{PATHS}, {_symbols('psym', 'parts', 'path', 'lower(path)')}, {_aligned('pal', 'slashed', 'psym', max(len(w) for _, t in rows for w in t.split() if '/' in w))}, inpath AS (SELECT query_id, pos, entry_id, s AS score FROM slashed JOIN pal USING (word) JOIN parts ON pal.norm = lower(path))"


@query(f"WITH {PARTS}, {_words(PATH_ASKED)}, {_paths(PATH_ASKED)} SELECT * FROM inpath")
def lex_path_word(spark, d):
    return channels.path_hits(channels.query_words(_asked(spark, PATH_ASKED)), parts(spark, d))


@query(f"WITH {PARTS}, {TOKENS}, {KEYS}, {_words()}, {PREFIX} SELECT word, norm, max(score + CASE WHEN key = word THEN complete ELSE 0 END) AS score, max(key = word AND complete > 0 AND score + complete = (SELECT max(b.score + CASE WHEN b.key = word THEN b.complete ELSE 0 END) FROM keys b WHERE b.entry_id = keys.entry_id AND starts_with(b.key, word))) AS complete FROM (SELECT DISTINCT word FROM words WHERE NOT contains(word, '/')) JOIN keys ON starts_with(key, word) JOIN (SELECT norm, min(entry_id) AS entry_id FROM parts GROUP BY ALL) USING (entry_id) GROUP BY ALL")
def lex_prefix_score(spark, d):
    words = channels.query_words(_asked(spark)).where("NOT contains(word, '/')").select("word").distinct()
    names = parts(spark, d).groupBy("norm").agg(F.min_by(F.struct("name", *T.LAYER.names), "entry_id").alias("n"))
    met = names.join(F.broadcast(words)).withColumn("p", channels.prefix_score(F.col("n"), F.col("word")))
    return met.where("p.score > 0").select("word", "norm", "p.score", "p.complete")


TERMS = "terms AS (SELECT DISTINCT entry_id, term FROM (SELECT entry_id, unnest(t) AS term FROM toks) WHERE length(term) BETWEEN 3 AND 32 AND NOT regexp_matches(term, '^[0-9]+$'))"
TYPO = """typos AS (SELECT DISTINCT query_id, pos, entry_id, 3500 AS score FROM words JOIN terms ON
  (damerau_levenshtein(term, word) = 1 OR (length(word) >= 5 AND NOT starts_with(term, word) AND length(term) >= 4 AND
    (damerau_levenshtein(left(term, length(word) - 1), word) = 1 OR damerau_levenshtein(left(term, length(word)), word) = 1 OR damerau_levenshtein(left(term, length(word) + 1), word) = 1)))
  WHERE length(word) BETWEEN 3 AND 32 AND NOT regexp_matches(word, '^[0-9]+$') AND NOT contains(word, '/'))"""


@query(f"WITH {PARTS}, {TOKENS}, {TERMS}, {_words()}, {TYPO} SELECT * FROM typos")
def lex_typo(spark, d):
    return channels.typo_hits(channels.query_words(_asked(spark)), channels.typo_terms(parts(spark, d)))


GRAMS = """grams AS (SELECT DISTINCT entry_id, unnest(list_transform(range(1, length(norm) - 1), lambda i: substr(norm, i, 3))) AS gram FROM parts WHERE length(norm) >= 3),
  freq AS (SELECT gram FROM grams GROUP BY ALL HAVING count(*) > greatest(64, (SELECT count(*) FROM parts) // 8)),
  asked AS (SELECT query_id, pos, g FROM (SELECT query_id, pos, list_distinct(list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3))) AS g FROM words WHERE length(word) >= 3 AND NOT contains(word, '/')) WHERE len(g) >= 3),
  told AS (SELECT query_id, pos, gram FROM (SELECT query_id, pos, unnest(g) AS gram FROM asked) WHERE gram NOT IN (SELECT gram FROM freq)),
  tot AS (SELECT query_id, pos, count(*) AS total FROM told GROUP BY ALL),
  tri AS (SELECT query_id, pos, entry_id, 1000 + (1000 * shared) // total AS score FROM (SELECT query_id, pos, entry_id, count(*) AS shared FROM told JOIN grams USING (gram) GROUP BY ALL) JOIN tot USING (query_id, pos) WHERE 2 * shared >= total)"""


@query(f"WITH {PARTS}, {_words()}, {GRAMS} SELECT * FROM tri")
def lex_trigram_overlap(spark, d):
    s = segments.build(parts(spark, d))
    return channels.trigram_hits(channels.query_words(_asked(spark)), s.grams, s.frequent)


@query(ORACLE_SQL["lex_trigram_overlap"])
def lex_trigram_rare_first(spark, d):
    s = segments.build(parts(spark, d))
    return staged.trigram_hits_by_rare(channels.query_words(_asked(spark)), s.grams, s.frequent)


@query(f"WITH {PARTS}, {TOKENS}, {KEYS}, {TERMS}, {_words()}, {PREFIX.replace('hits AS', 'pre AS')}, {TYPO}, {GRAMS}, hits AS (SELECT * FROM pre UNION ALL SELECT * FROM typos UNION ALL SELECT * FROM tri), {NEED}, {TOTALS} {_final(20)}")
def lex_multiword_all(spark, d):
    asked, s = _asked(spark), segments.build(parts(spark, d))
    words = channels.query_words(asked)
    hits = [channels.prefix_hits(words, s.keys), channels.typo_hits(words, s.terms), channels.trigram_hits(words, s.grams, s.frequent)]
    return search.ranked(search.scored(search.combined(words, *hits), asked, s.entries), 20)


#: All channels of a name, its path and its fields; without folders.
CHANNELS = f"{PARTS}, {TOKENS}, {KEYS}, {TERMS}, {_words()}, {PLAIN}, {PREFIX.replace('hits AS', 'pre AS')}, {TYPO}, {GRAMS}, {SYM}, {ALIGNED}, {_paths(ASKED)}, sub AS (SELECT query_id, pos, entry_id, s + 1500 AS score FROM plain JOIN al USING (word) JOIN parts USING (norm))"
EVERY = "SELECT * FROM pre UNION ALL SELECT * FROM typos UNION ALL SELECT * FROM tri UNION ALL SELECT * FROM sub UNION ALL SELECT * FROM inpath"
#: What folders say, by the nearest that says anything.
FOLDERS = f"""dirs AS (SELECT DISTINCT folder, name, lower(name) AS norm, hash(folder) AS entry_id, folder AS path FROM (SELECT '/parts' AS folder, 'parts' AS name UNION ALL SELECT '/parts/' || p_brand, p_brand FROM part)),
  {TOKENS.replace('toks AS', 'dtoks AS').replace('FROM parts', 'FROM dirs')}, {KEYS.replace('keys AS', 'dkeys AS').replace('FROM toks', 'FROM dtoks')}, {_symbols('dsym', 'dirs', 'name', 'norm')}, {_aligned('dal', 'plain', 'dsym', LONGEST)},
  said AS (SELECT query_id, pos, folder, max(score) AS score FROM (SELECT query_id, pos, folder, s AS score FROM plain JOIN dal USING (word) JOIN dirs USING (norm) UNION ALL SELECT query_id, pos, folder, 2500 FROM plain JOIN dkeys ON starts_with(key, word) JOIN dirs USING (entry_id)) GROUP BY ALL),
  lies AS (SELECT entry_id, '/parts/' || p_brand AS folder, 1 AS distance FROM parts UNION ALL SELECT entry_id, '/parts', 2 FROM parts),
  above AS (SELECT query_id, pos, entry_id, arg_min(score, distance) AS score FROM said JOIN lies USING (folder) GROUP BY ALL)"""


@query(f"WITH {CHANNELS}, {FOLDERS} SELECT * FROM above")
def lex_parent_context(spark, d):
    items = parts(spark, d)
    return channels.parent_hits(channels.folder_evidence(channels.query_words(_asked(spark)), catalog.folders(items)), items)


def placed(spark, d):
    """Parts with the penalty of their place below the root /parts; and the root."""
    roots = spark.createDataFrame([("/parts",)], "path string")
    return catalog.with_root(parts(spark, d), roots).withColumn("place", catalog.place_penalty(F.col("path"), F.col("root"))).drop("root"), roots


FULL = f"{CHANNELS}, {FOLDERS}, hits AS ({EVERY} UNION ALL SELECT * FROM above WHERE (query_id, pos, entry_id) NOT IN (SELECT (query_id, pos, entry_id) FROM sub)), {NEED}, {TOTALS}"


@query(f"WITH {FULL} {_final(10)}")
def lex_search_full(spark, d):
    items, roots = placed(spark, d)
    return search.search(_asked(spark), items, True, roots=roots, apart=True)  # the SQL lists a path that is asked twice


@query(f"WITH {CHANNELS}, hits AS ({EVERY}), {NEED}, {TOTALS} {_final(10)}")
def lex_search_staged(spark, d):
    return staged.one_word_topk(_asked(spark), segments.build(parts(spark, d)), apart=True)  # as lex_search_full


@query(f"""WITH {PARTS}, {TOKENS}, {KEYS}, best AS (SELECT key[1] AS query_id, entry_id, max(score + CASE WHEN length(key) = 1 THEN complete ELSE 0 END) AS s FROM keys WHERE regexp_matches(key, '^[a-z0-9]') GROUP BY ALL)
  SELECT * FROM (SELECT query_id, entry_id, path, s + greatest(0, 64 - length(norm)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s + greatest(0, 64 - length(norm)) DESC, path, entry_id) AS rank FROM best JOIN parts USING (entry_id)) WHERE rank <= 1000""")
def top_symbol_cache(spark, d):
    return search.symbol_answers(parts(spark, d))


FIELD_ASKED = [(1, "promo"), (2, "bra"), (3, "stand"), (4, "brand"), (5, "12")]


@query(f"""WITH f AS (SELECT p_partkey AS entry_id, 2800 AS w, p_brand AS text FROM part UNION ALL SELECT p_partkey, 2600, p_type FROM part), {_words(FIELD_ASKED)},
  ft AS (SELECT entry_id, w, lower(text) AS norm, list_transform({_tok('text')}, lambda t: lower(t)) AS t FROM f),
  k AS (SELECT entry_id, w, norm AS key, 0 AS complete FROM ft UNION ALL SELECT entry_id, w, unnest(t), 128 FROM ft UNION ALL SELECT entry_id, w, array_to_string(list_transform(t, lambda x: x[1]), ''), 0 FROM ft),
  {_symbols('fsym', 'f', 'text', 'lower(text)')}, {_aligned('fal', 'words', 'fsym', 5)}
  SELECT query_id, pos, entry_id, max(s) AS score FROM (SELECT query_id, pos, entry_id, w + CASE WHEN key = word THEN complete ELSE 0 END AS s FROM words JOIN k ON starts_with(key, word) UNION ALL SELECT query_id, pos, entry_id, s FROM words JOIN fal USING (word) JOIN ft USING (norm)) GROUP BY ALL""")
def lex_field_prefix(spark, d):
    return channels.field_hits(channels.query_words(_asked(spark, FIELD_ASKED)), part_fields(spark, d))


def part_fields(spark, d):
    p = _t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("entry_id"), F.lit("generic").alias("kind"), F.col("p_brand").alias("text")).union(p.select("p_partkey", F.lit("keyword"), "p_type"))


#: Names with letters beyond ASCII: the first words of documents, with upper case put back.
DOCS = """docs AS (SELECT doc_id AS entry_id, name, replace(lower(nfc_normalize(name)), 'ß', 'ss') AS norm FROM (SELECT doc_id, upper(w[1]) || '_' || coalesce(w[2], '') || '.' || coalesce(w[3], '') AS name FROM (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '[^\\p{L}\\p{N} ]', ' ', 'g'), '[ ]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0))"""


def doc_names(spark, d):
    w = F.filter(F.split(F.regexp_replace("text", "[^\\p{L}\\p{N} ]", " "), "[ ]+"), lambda x: x != "")
    df = _t(spark, d, "documents").select("doc_id", w.alias("w")).where("size(w) > 0")
    at = lambda k: F.coalesce(F.try_element_at("w", F.lit(k)), F.lit(""))
    # upper case symbol by symbol: what has no single capital (ß) stays
    up = F.array_join(F.transform(T.symbols(at(1)), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")
    return df.select(F.col("doc_id").alias("entry_id"), F.concat(up, F.lit("_"), at(2), F.lit("."), at(3)).alias("name"))


@query(f"WITH {DOCS} SELECT entry_id, norm, length(norm) AS symbols FROM docs")
def lex_fold(spark, d):
    n = catalog.named(doc_names(spark, d))
    return n.select("entry_id", "norm", F.length("norm").cast("long").alias("symbols"))


# --- the path tree -----------------------------------------------------------------------------------------

FILES = "files AS (SELECT page_id AS entry_id, '/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/?([?#].*)?$', '') AS path FROM pages)"
UPS = """ups AS (SELECT entry_id, path, k AS distance, '/' || array_to_string(p[1:len(p) - k], '/') AS folder FROM (SELECT entry_id, path, p, unnest(range(1, len(p))) AS k FROM (
  SELECT entry_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM files)))"""


def files(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/?([?#].*)?$", ""))
    return catalog.entries(_t(spark, d, "pages"), F.col("page_id"), path)


@query(f"""WITH {FILES} SELECT entry_id, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS folder, nullif(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]+)$', 1), '') AS ext FROM files""")
def path_split(spark, d):
    return files(spark, d).select("entry_id", "name", "folder", T.extension(F.col("name"), F.col("is_dir")).alias("ext"))


@query(f"WITH {FILES}, {UPS} SELECT folder, count(*) AS n_entries FROM ups GROUP BY ALL")
def dir_descendants(spark, d):
    return catalog.descendants(files(spark, d))


@query(f"""WITH {FILES}, {UPS} SELECT 1 AS query_id, 0 AS pos, entry_id, arg_min(length(folder), distance) AS score FROM ups WHERE regexp_matches(regexp_extract(folder, '[^/]*$'), '^[de]') GROUP BY ALL""")
def dir_nearest(spark, d):
    f = files(spark, d)
    said = catalog.folders(f).where(F.col("name").rlike("^[de]")).select(F.lit(1).alias("query_id"), F.lit(0).alias("pos"), "folder", F.length("folder").alias("score"))
    return channels.parent_hits(said, f)


@query(f"""WITH {FILES}, r AS (SELECT entry_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM files)
  SELECT entry_id, least(256, greatest(0, len(p) - 1 - 3) * 24 + CASE WHEN len(list_filter(p[1:len(p) - 1], lambda x: regexp_matches(lower(x), '^v?[0-9]{{1,3}}([.][0-9]+)+$|@v[0-9]') OR lower(x) IN ('vendor', 'sdk', 'en'))) > 0 THEN 128 ELSE 0 END) AS place FROM r""".replace(" IN ('vendor', 'sdk', 'en')", " IN ('node_modules', 'bower_components', 'site-packages', 'dist-packages', 'vendor', 'third_party', 'third-party', 'thirdparty', 'sysroot', 'sdk')"))
def place_penalty(spark, d):
    return files(spark, d).select("entry_id", catalog.place_penalty(F.col("path"), F.lit("/")).alias("place"))


ROOTS = "roots AS (SELECT DISTINCT '/' || h || '/' || l AS path FROM (SELECT split_part(path, '/', 2) AS h, split_part(path, '/', 3) AS l, entry_id FROM files) WHERE entry_id % 3 = 0 UNION SELECT DISTINCT '/' || split_part(path, '/', 2) FROM files WHERE entry_id % 5 = 0)"


def _roots(spark, d):
    p = F.split("path", "/")
    f = files(spark, d)
    return f.where("entry_id % 3 = 0").select(F.concat(F.lit("/"), p[1], F.lit("/"), p[2]).alias("path")).union(f.where("entry_id % 5 = 0").select(F.concat(F.lit("/"), p[1]))).distinct()


@query(f"""WITH {FILES}, {ROOTS}, m AS (SELECT f.entry_id, f.path, arg_max(r.path, length(r.path)) AS root FROM files f LEFT JOIN roots r ON f.path = r.path OR starts_with(f.path, r.path || '/') GROUP BY ALL)
  SELECT entry_id, root, substr(path, length(root) - length(regexp_extract(root, '[^/]*$')) + 1) AS context FROM m""")
def context_path(spark, d):
    met = catalog.with_root(files(spark, d), _roots(spark, d))
    return met.select("entry_id", "root", catalog.context_path(F.col("path"), F.col("root")).alias("context"))


@query(f"WITH {FILES}, {ROOTS} SELECT path FROM roots r WHERE NOT EXISTS (SELECT 1 FROM roots o WHERE o.path <> r.path AND starts_with(r.path, o.path || '/'))")
def root_cover(spark, d):
    return catalog.cover(_roots(spark, d))


@query(f"""WITH {FILES}, {ROOTS}, x AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM files WHERE entry_id % 7 = 0), a AS (SELECT path FROM files WHERE entry_id % 11 = 0)
  SELECT entry_id, CASE WHEN EXISTS (SELECT 1 FROM x WHERE f.path = x.path OR starts_with(f.path, x.path || '/')) THEN 'excluded' WHEN path IN (SELECT path FROM a) THEN 'allowed'
    WHEN EXISTS (SELECT 1 FROM a WHERE starts_with(a.path, f.path || '/')) THEN 'transit' WHEN len(list_filter(string_split(path, '/'), lambda c: c[1] = '.' OR c IN ('build', 'target'))) > 0 THEN 'ignored' ELSE 'index' END AS scope FROM files f""")
def scope_classify(spark, d):
    f = files(spark, d)
    return catalog.classified(f, f.where("entry_id % 7 = 0").select(F.col("folder").alias("path")).distinct(), f.where("entry_id % 11 = 0").select("path")).select("entry_id", "scope")


@query(f"""WITH {PARTS}, gone AS (SELECT entry_id FROM parts WHERE entry_id % 10 = 3), delta AS (SELECT entry_id, path || '.new' AS path FROM parts WHERE entry_id % 10 = 5)
  SELECT entry_id, path FROM parts WHERE entry_id % 10 NOT IN (3, 5) UNION ALL SELECT * FROM delta""")
def store_live_view(spark, d):
    p = parts(spark, d).select("entry_id", "path")
    return catalog.live(p, p.where("entry_id % 10 = 5").withColumn("path", F.concat("path", F.lit(".new"))), p.where("entry_id % 10 = 3"))


@query(f"""WITH {FILES}, {UPS}, t AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM files WHERE regexp_matches(path, '/4[^/]*$'))
  SELECT entry_id, path FROM files WHERE path NOT IN (SELECT folder FROM t) AND entry_id NOT IN (SELECT entry_id FROM ups JOIN t USING (folder))""")
def tool_managed(spark, d):
    f = files(spark, d)
    # names that begin with 4 play the marker here: the page catalog has no tools
    marked = f.withColumn("name", F.when(F.col("name").rlike("^4"), "pyvenv.cfg").otherwise(F.col("name")))
    return catalog.outside(f, catalog.tool_managed(marked)).select("entry_id", "path")


@query(f"""WITH {PARTS} SELECT p_partkey AS entry_id, path, CASE WHEN path IS NULL THEN 'stale' ELSE 'live' END AS state FROM part LEFT JOIN (SELECT entry_id, path FROM parts WHERE entry_id % 4 > 0) ON entry_id = p_partkey""")
def resolve_ids(spark, d):
    p = parts(spark, d)
    return catalog.resolved(p.select("entry_id"), p.where("entry_id % 4 > 0")).select("entry_id", "path", "state")


@query(f"""WITH {PARTS}, o AS (SELECT entry_id AS id, p_type AS fingerprint, 5000 + entry_id AS old FROM parts WHERE entry_id % 3 = 0), f AS (SELECT entry_id AS id, CASE WHEN entry_id % 6 = 0 THEN 'changed' ELSE p_type END AS fingerprint FROM parts WHERE entry_id % 2 = 0 OR entry_id % 3 = 0),
  m AS (SELECT lpad(CAST(f.id AS VARCHAR), 9, '0') AS desktop_id, CASE WHEN o.fingerprint = f.fingerprint THEN old END AS k FROM f LEFT JOIN o USING (id))
  SELECT desktop_id, coalesce(k, (SELECT max(old) FROM o) + row_number() OVER (PARTITION BY k IS NULL ORDER BY desktop_id)) AS entry_id FROM m""")
def stable_app_ids(spark, d):
    p = _t(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("desktop_id"), F.col("p_type").alias("fingerprint"), "p_partkey")
    old = p.where("p_partkey % 3 = 0").withColumn("entry_id", F.col("p_partkey") + 5000).drop("p_partkey")
    new = p.where("p_partkey % 2 = 0 OR p_partkey % 3 = 0").withColumn("fingerprint", F.when(F.col("p_partkey") % 6 == 0, "changed").otherwise(F.col("fingerprint"))).drop("p_partkey")
    return catalog.stable_ids(old, new).select("desktop_id", "entry_id")


# --- usage and history -------------------------------------------------------------------------------------

OPENS = f"opens AS (SELECT event_id, event_id % (SELECT count(*) FROM part) + 1 AS target_id, CASE WHEN event_type IN ('click', 'view') THEN ['red wid', 'blue', 'Hot  Rod', 'new gizmo'][1 + event_id % 4] END AS query, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events)"


def opens(spark, d) -> DataFrame:
    n = _t(spark, d, "part").agg(F.count("*").alias("_n"))
    q = F.element_at(F.array(*[F.lit(x) for x in ("red wid", "blue", "Hot  Rod", "new gizmo")]), (F.col("event_id") % 4 + 1).cast("int"))
    e = _t(spark, d, "events").join(F.broadcast(n))
    return e.select("event_id", (F.col("event_id") % F.col("_n") + 1).alias("target_id"), F.when(F.col("event_type").isin("click", "view"), q).alias("query"), F.unix_timestamp("ts").alias("ts"))


ITEMS = f"items AS (SELECT target_id, sum(pow(2.0, -greatest({NOW} - ts, 0) / 1209600.0)) AS weight, max(ts) AS last_open FROM opens GROUP BY ALL)"


@query(f"WITH {OPENS}, {ITEMS} SELECT target_id, round(weight, 6) AS weight, last_open, CAST(round(400 * weight / (weight + 2)) AS INT) AS boost FROM items")
def usage_frecency(spark, d):
    return usage.items(opens(spark, d), NOW).select("target_id", F.round("weight", 6).alias("weight"), "last_open", usage.boost(F.col("weight"), usage.ITEM_BOOST, usage.ITEM_HALF).alias("boost"))


TYPED = [(1, "red"), (2, "hot ro"), (3, ""), (4, "b"), (5, "zz")]


RETAINED = NOW - 90 * 86400


def _boosts(asked) -> str:
    """CTE boosts (query_id, entry_id, boost) of usage.boosts(), for the texts asked."""
    return f"""kept AS (SELECT * FROM items WHERE last_open >= {RETAINED} ORDER BY weight DESC, target_id LIMIT 2048), typed AS (SELECT query_id, trim(regexp_replace(lower(text), '[ ]+', ' ', 'g')) AS t FROM {_values(asked)}),
  pairs AS (SELECT * FROM (SELECT trim(regexp_replace(lower(query), '[ ]+', ' ', 'g')) AS k, target_id, sum(pow(2.0, -greatest({NOW} - ts, 0) / 1209600.0)) AS w, max(ts) AS last FROM opens WHERE query IS NOT NULL GROUP BY ALL) WHERE last >= {RETAINED} ORDER BY w DESC, k, target_id LIMIT 4096),
  boosts AS (SELECT CAST(NULL AS INT) AS query_id, target_id AS entry_id, CAST(round(400 * weight / (weight + 2)) AS INT) AS boost FROM kept
    UNION ALL SELECT * FROM (SELECT query_id, target_id, CAST(round(1200 * sum(w) / (sum(w) + 1)) AS INT) AS boost FROM typed JOIN pairs ON t <> '' AND length(t) <= 32 AND starts_with(k, t) WHERE target_id IN (SELECT target_id FROM kept) GROUP BY ALL) WHERE boost > 0)"""


@query(f"WITH {OPENS}, {ITEMS}, {_boosts(TYPED)} SELECT * FROM boosts")
def usage_query_boost(spark, d):
    return usage.boosts(_asked(spark, TYPED), opens(spark, d), NOW)


@query(f"WITH {OPENS}, {ITEMS} SELECT target_id, last_open, round(weight, 6) AS weight FROM items WHERE last_open >= {NOW} - 20 * 86400")
def usage_retention(spark, d):
    return usage.items(opens(spark, d), NOW, 20).select("target_id", "last_open", F.round("weight", 6).alias("weight"))


@query(f"""WITH {OPENS}, a AS (SELECT target_id, event_id % 2 AS half, sum(pow(2.0, -(({NOW} - event_id % 2 * 864000) - ts) / 1209600.0)) AS w, {NOW} - event_id % 2 * 864000 AS t FROM opens WHERE ts <= {NOW} - 864000 GROUP BY ALL)
  SELECT target_id, max(t) AS "at", round(sum(w * pow(2.0, -(m - t) / 1209600.0)), 6) AS weight FROM (SELECT *, max(t) OVER (PARTITION BY target_id) AS m FROM a) GROUP BY ALL""")
def usage_merge(spark, d):
    o = opens(spark, d).where(F.col("ts") <= NOW - 864000)
    half = lambda k: usage.items(o.where(F.col("event_id") % 2 == k), NOW - k * 864000).select("target_id", "weight", F.lit(NOW - k * 864000).cast("long").alias("at"))
    return usage.merged(half(0), half(1), NOW).select("target_id", "at", F.round("weight", 6).alias("weight"))


@query(f"WITH {OPENS}, {ITEMS} SELECT CAST(target_id AS VARCHAR) AS desktop_id, round(weight / pow(2.0, -{NOW} / 1209600.0 + {NOW} / 1209600.0), 6) AS weight, CAST(target_id // 2 AS INT) AS position FROM items JOIN part ON p_partkey = target_id WHERE target_id % 2 = 0")
def usage_applications(spark, d):
    own = usage.items(opens(spark, d), NOW).select(F.col("target_id").cast("string").alias("desktop_id"), F.round("weight", 6).alias("weight"))
    apps = _t(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("desktop_id"), F.expr("CAST(p_partkey div 2 AS INT)").alias("position"))
    return usage.applications(own, apps.unionByName(apps.withColumn("position", F.col("position") + 9_000_000)))


@query(f"""WITH {OPENS}, {ITEMS} SELECT target_id, round(log2(weight) + {NOW} / 1209600.0, 6) AS strength FROM items""")
def usage_strength(spark, d):
    return usage.items(opens(spark, d), NOW).select("target_id", F.round("strength", 6).alias("strength"))


@query(f"WITH {OPENS}, {ITEMS} SELECT target_id, round(weight, 6) AS weight FROM items ORDER BY round(weight, 12) DESC, target_id LIMIT 500")
def usage_evict(spark, d):
    i = usage.items(opens(spark, d), NOW).withColumn("weight", F.round("weight", 12))
    return usage.strongest(i, ["target_id"], 500).select("target_id", F.round("weight", 6).alias("weight"))


@query(f"WITH {OPENS} SELECT event_id, target_id, ts FROM opens WHERE ts >= {NOW - 14 * 86400}")
def hist_prune(spark, d):
    return history.pruned(opens(spark, d).select("event_id", "target_id", "ts"), NOW - 14 * 86400)


@query("""WITH s AS (SELECT DISTINCT 'search ' || user_id AS query, user_id AS search_id FROM events WHERE user_id % 2 = 0)
  SELECT event_id, CASE WHEN event_type = 'view' THEN 'file' ELSE 'app' END AS kind, event_id % 100 AS target_id, query, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events LEFT JOIN s ON user_id = search_id WHERE event_type IN ('view', 'click')""")
def hist_opens_union(spark, d):
    e = _t(spark, d, "events").select("event_id", (F.col("event_id") % 100).alias("target_id"), F.col("user_id").alias("search_id"), F.unix_timestamp("ts").alias("ts"), "event_type")
    s = e.where("search_id % 2 = 0").select("search_id", F.concat(F.lit("search "), F.col("search_id").cast("string")).alias("query")).distinct()
    return history.all_opens(e.where("event_type = 'view'"), e.where("event_type = 'click'"), s)


@query("""WITH o AS (SELECT event_id, event_id % 100 AS target_id, user_id AS ts FROM events WHERE event_id % 2 = 0), a AS (SELECT event_id, event_id % 100 + event_id // 50 % 2 * 200 AS target_id, user_id + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS ts FROM events),
  i AS (SELECT DISTINCT event_id % 100 AS target_id FROM events)
  SELECT a.event_id, CASE WHEN o.event_id IS NOT NULL AND o.target_id = a.target_id AND o.ts = a.ts THEN 'repeated' WHEN o.event_id IS NOT NULL THEN 'conflict' WHEN i.target_id IS NULL THEN 'missing' ELSE 'accepted' END AS verdict
  FROM a LEFT JOIN o USING (event_id) LEFT JOIN i ON i.target_id = a.target_id""")
def hist_record(spark, d):
    e = _t(spark, d, "events")
    o = e.where("event_id % 2 = 0").select("event_id", (F.col("event_id") % 100).alias("target_id"), F.col("user_id").alias("ts"))
    a = e.select("event_id", F.expr("event_id % 100 + (event_id div 50) % 2 * 200").alias("target_id"), (F.col("user_id") + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).alias("ts"))
    i = e.select((F.col("event_id") % 100).alias("entry_id")).distinct()
    return history.recorded(o, a, i).select("event_id", "verdict")


# --- vectors -----------------------------------------------------------------------------------------------

VECS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT id AS query_id, v AS qv FROM v WHERE id % 50 = 0)"
BYTES = "b AS (SELECT id, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)) * 127)) AS v FROM v)"


def _topv(select: str, k: int) -> str:
    return f"SELECT query_id, id, round(cosine, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rank FROM ({select})) WHERE rank <= {k}"


def _vectors(spark, d):
    v = vectors.prepared(_t(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")))
    return v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")


def _rounded(df):
    return df.select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


@query(f"WITH {VECS} {_topv('SELECT query_id, id, list_cosine_similarity(v, qv) AS cosine FROM v, q WHERE list_cosine_similarity(v, qv) >= 0.2', 20)}")
def vec_cosine_topk(spark, d):
    return _rounded(vectors.nearest(*_vectors(spark, d), 20))


@query(f"WITH {VECS}, {BYTES} {_topv('SELECT q.query_id, b.id, list_cosine_similarity(b.v, c.v) AS cosine FROM b, q JOIN b c ON c.id = q.query_id WHERE list_cosine_similarity(b.v, c.v) >= 0.2', 20)}")
def vec_int8_topk(spark, d):
    return _rounded(vectors.nearest_bytes(*_vectors(spark, d), 20))


#: Shortlists that keep at least nine tenths of the exact answers, see vec_recall.
HEAD, HEAD_ROWS, BIT_ROWS = 40, 250, 400
BY_HEAD = f"f AS (SELECT q.query_id, b.id, b.v, c.v AS qv, row_number() OVER (PARTITION BY q.query_id ORDER BY list_inner_product(b.v[1:{HEAD}], c.v[1:{HEAD}]) / sqrt(list_inner_product(b.v[1:{HEAD}], b.v[1:{HEAD}])) DESC, b.id) AS r FROM b, q JOIN b c ON c.id = q.query_id)"
BY_BITS = "g AS (SELECT query_id, id, v, qv, row_number() OVER (PARTITION BY query_id ORDER BY len(list_filter(range(1, len(v) + 1), lambda i: (v[i] < 0) <> (qv[i] < 0))), id) AS r FROM v, q)"


@query(f"WITH {VECS}, {BYTES}, {BY_HEAD} {_topv(f'SELECT query_id, id, list_cosine_similarity(v, qv) AS cosine FROM f WHERE r <= {HEAD_ROWS}', 10)}")
def vec_prefix_two_pass(spark, d):
    return _rounded(vectors.nearest_two_pass(*_vectors(spark, d), 10, HEAD, HEAD_ROWS))


@query(f"WITH {VECS}, {BY_BITS} {_topv(f'SELECT query_id, id, list_cosine_similarity(v, qv) AS cosine FROM g WHERE r <= {BIT_ROWS}', 10)}")
def vec_hamming(spark, d):
    return _rounded(vectors.nearest_bits(*_vectors(spark, d), 10, BIT_ROWS))


def _best(select: str) -> str:
    return f"(SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rank FROM ({select})) WHERE rank <= 10)"


@query(f"""WITH {VECS}, {BYTES}, {BY_HEAD}, {BY_BITS}, e AS {_best('SELECT query_id, id, list_cosine_similarity(v, qv) AS cosine FROM v, q')}, eb AS {_best('SELECT q.query_id, b.id, list_cosine_similarity(b.v, c.v) AS cosine FROM b, q JOIN b c ON c.id = q.query_id')}
  SELECT 'prefix' AS shortlist, round(count(f.id) / count(*), 6) AS recall FROM eb LEFT JOIN (SELECT query_id, id FROM f WHERE r <= {HEAD_ROWS}) f ON f.query_id = eb.query_id AND f.id = eb.id
  UNION ALL SELECT 'bits', round(count(g.id) / count(*), 6) FROM e LEFT JOIN (SELECT query_id, id FROM g WHERE r <= {BIT_ROWS}) g ON g.query_id = e.query_id AND g.id = e.id""")
def vec_recall(spark, d):
    v, q = _vectors(spark, d)
    of = lambda name, found, exact: vectors.recall(found, exact).select(F.lit(name).alias("shortlist"), F.round("recall", 6).alias("recall"))
    return of("prefix", vectors.nearest_two_pass(v, q, 10, HEAD, HEAD_ROWS), vectors.nearest_bytes(v, q, 10, None)).union(of("bits", vectors.nearest_bits(v, q, 10, BIT_ROWS), vectors.nearest(v, q, 10, None)))


@query("""SELECT o_orderpriority AS id, i, round(avg(v[i]), 6) AS x FROM (SELECT o_orderpriority, embedding::DOUBLE[] AS v, unnest(range(1, len(embedding) + 1)) AS i FROM orders JOIN embeddings ON vec_id = o_orderkey % 500) GROUP BY ALL""")
def vec_pool_mean(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("id"), F.array((F.col("o_orderkey") % 500).cast("string")).alias("tokens"))
    v = _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("token"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return vectors.pooled(o, v).select("id", F.posexplode("v").alias("_i", "_x")).select("id", (F.col("_i") + 1).cast("long").alias("i"), F.round("_x", 6).alias("x"))


@query(f"""WITH {VECS}, a AS (SELECT query_id, id, 'p' || id AS path, id % 3 AS priority, row_number() OVER (PARTITION BY query_id ORDER BY id % 17, id) AS rank FROM v, q WHERE id % 4 = 0),
  b AS (SELECT query_id, id, 'p' || id AS path, 0 AS priority, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, qv), 9) DESC, id) AS rank FROM v, q WHERE query_id <> 50),
  f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, coalesce(a.path, b.path) AS path, greatest(a.priority, b.priority) AS priority, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS score, a.rank AS lexical_rank, b.rank AS semantic_rank FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id),
  l AS (SELECT *, max(semantic_rank) OVER (PARTITION BY query_id) IS NULL AS lone FROM f)
  SELECT query_id, id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lone THEN 0 ELSE priority END DESC, CASE WHEN lone THEN 0 ELSE round(score, 12) END DESC, lexical_rank NULLS LAST, path, id) AS rank FROM l) WHERE rank <= 100""")
def rank_rrf(spark, d):
    from pyspark.sql import Window as W

    v, q = _vectors(spark, d)
    path = F.concat(F.lit("p"), F.col("id").cast("string")).alias("path")
    by = lambda *o: F.row_number().over(W.partitionBy("query_id").orderBy(*o))
    every = v.where("id % 4 = 0").select("id").join(shared.sent(q.select("query_id")))
    a = every.select("query_id", "id", path, (F.col("id") % 3).alias("priority"), by(F.col("id") % 17, "id").alias("rank"))
    b = vectors.ranked_all(v, q.where("query_id <> 50")).select("query_id", "id", path, F.lit(0).cast("long").alias("priority"), "rank")
    return vectors.fused(a, b, limit=100).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query("""WITH c AS (SELECT label AS text_hash, min(vec_id) AS v FROM embeddings WHERE label < 6 GROUP BY ALL) SELECT vec_id AS id, label AS text_hash, v IS NOT NULL AS reused FROM embeddings LEFT JOIN c ON label = text_hash""")
def vec_reuse(spark, d):
    e = _t(spark, d, "embeddings")
    cached = e.where("label < 6").groupBy(F.col("label").alias("text_hash")).agg(F.min("vec_id").alias("v"))
    return vectors.reusable(cached, e.select(F.col("vec_id").alias("id"), F.col("label").alias("text_hash"))).select("id", "text_hash", F.col("v").isNotNull().alias("reused"))


# --- merging -----------------------------------------------------------------------------------------------

MIXED = """m AS (SELECT o_custkey % 40 AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 'app' ELSE 'file' END AS kind, o_orderkey AS entry_id, 'p' || o_orderkey AS path,
  CAST(CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 101 = 0 THEN 20000000 WHEN o_orderkey % 3 > 0 AND o_orderkey % 53 = 0 THEN 9999900 ELSE o_orderkey * 7919 % 9000 END AS BIGINT) AS score, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 3 % 4 ELSE 0 END AS INT) AS evidence, CAST(CASE WHEN o_orderkey % 13 = 0 THEN 300 ELSE 0 END AS BIGINT) AS boost FROM orders)"""


def _mixed(spark, d):
    return _t(spark, d, "orders").selectExpr(
        "o_custkey % 40 AS query_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'app' ELSE 'file' END AS kind", "o_orderkey AS entry_id", "concat('p', o_orderkey) AS path",
        "CAST(CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 101 = 0 THEN 20000000 WHEN o_orderkey % 3 > 0 AND o_orderkey % 53 = 0 THEN 9999900 ELSE o_orderkey * 7919 % 9000 END AS BIGINT) AS score",
        "CAST(CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey div 3) % 4 ELSE 0 END AS INT) AS evidence", "CAST(CASE WHEN o_orderkey % 13 = 0 THEN 300 ELSE 0 END AS BIGINT) AS boost")


@query(f"""WITH {MIXED}, t AS (SELECT *, CASE WHEN kind = 'file' AND score >= 20000000 THEN 0 WHEN kind = 'app' AND evidence = 3 THEN 1 WHEN kind = 'file' AND score >= 9999744 THEN 2 WHEN kind = 'app' AND evidence = 2 THEN 3 ELSE 4 END AS tier FROM m)
  SELECT query_id, kind, entry_id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, kind, path, entry_id) AS rank FROM t) WHERE rank <= 100""")
def merge_tiers(spark, d):
    return merge.tiered(_mixed(spark, d), 100).select("query_id", "kind", "entry_id", "tier", "rank")


@query(f"""WITH {MIXED}, q AS (SELECT *, query_id % 2 = 0 AS one FROM (SELECT DISTINCT query_id FROM m)), a AS (SELECT query_id, max(CASE WHEN kind = 'file' THEN CAST(score >= 4244 AND score - boost >= 4244 AS INT) ELSE CAST(evidence > 0 AS INT) END) AS any_start FROM m WHERE score < 9000000 AND score % 5 <> query_id % 5 GROUP BY ALL)
  SELECT query_id, kind, entry_id FROM m JOIN q USING (query_id) JOIN a USING (query_id) WHERE score < 9000000 AND score % 5 <> query_id % 5 AND (NOT (one AND any_start = 1) OR boost > 0 OR (kind = 'file' AND score >= 4244) OR (kind = 'app' AND evidence > 0))""")
def merge_drop_fuzzy(spark, d):
    m = _mixed(spark, d).where("score < 9000000 AND score % 5 <> query_id % 5")
    q = m.select("query_id").distinct().withColumn("text", F.when(F.col("query_id") % 2 == 0, "word").otherwise("two words"))
    return merge.without_padding(m, q).select("query_id", "kind", "entry_id")


@query(f"""WITH {PARTS}, {_words([(1, 'red'), (2, 'widget promo'), (3, 'br hot'), (4, 'brand 7'), (5, 'rw'), (6, 'hot zz')])},
  a AS (SELECT entry_id, p_name AS name, lower(p_name) AS norm, '' AS path FROM parts), {TOKENS.replace('FROM parts', 'FROM a')}, {KEYS},
  f AS (SELECT entry_id, p_brand AS text FROM parts UNION ALL SELECT entry_id, p_type FROM parts), fk AS (SELECT DISTINCT entry_id, key, complete FROM (SELECT entry_id, lower(text) AS key, 0 AS complete FROM f UNION ALL SELECT entry_id, unnest(list_transform({_tok('text')}, lambda t: lower(t))), 128 FROM f)),
  e AS (SELECT query_id, pos, entry_id, max(e) AS e FROM (SELECT query_id, pos, entry_id, 3 AS e FROM words JOIN keys ON starts_with(key, word) UNION ALL SELECT query_id, pos, entry_id, CASE WHEN key = word AND complete > 0 THEN 2 ELSE 1 END FROM words JOIN fk ON starts_with(key, word)) GROUP BY ALL), {NEED}
  SELECT query_id, entry_id, CASE WHEN n < need THEN 0 ELSE least_e END AS evidence FROM (SELECT query_id, entry_id, count(*) AS n, min(e) AS least_e FROM e GROUP BY ALL) JOIN need USING (query_id)""")
def app_evidence(spark, d):
    p = _t(spark, d, "part")
    apps = p.select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("name"))
    fields = p.select(F.col("p_partkey").alias("entry_id"), F.col("p_brand").alias("text")).union(p.select("p_partkey", "p_type"))
    return merge.app_evidence(_asked(spark, [(1, "red"), (2, "widget promo"), (3, "br hot"), (4, "brand 7"), (5, "rw"), (6, "hot zz")]), apps, fields)


@query(f"""WITH {MIXED}, r AS (SELECT query_id, entry_id, evidence, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM m)
  SELECT query_id, entry_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY f, rank) AS position FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, evidence) AS f FROM r)""")
def group_order(spark, d):
    from pyspark.sql import Window as W

    r = _mixed(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")))
    return merge.grouped(r.select("query_id", "entry_id", "evidence", "rank"), "evidence").select("query_id", "entry_id", "rank", "position")


# --- maintenance -------------------------------------------------------------------------------------------

SAVED = "saved AS (SELECT l_orderkey * 10 + l_linenumber AS id, '/o/' || l_orderkey % 50 || '/' || l_orderkey || '/' || l_linenumber AS path, false AS is_dir, CAST(l_quantity AS BIGINT) AS mtime, CAST(floor(l_extendedprice) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS identity FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice))"
SCAN = "scan AS (SELECT CASE WHEN id % 31 = 0 THEN path || 'n' ELSE path END AS path, is_dir, CASE WHEN id % 7 = 0 THEN mtime + 1 ELSE mtime END AS mtime, size, CASE WHEN id % 3 = 0 THEN 'x' END AS identity FROM saved WHERE id % 13 > 0)"


def _saved(spark, d):
    from pyspark.sql import Window as W

    one = _t(spark, d, "lineitem").withColumn("_n", F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_extendedprice"))).where("_n = 1")
    s = one.selectExpr("l_orderkey * 10 + l_linenumber AS id", "concat('/o/', l_orderkey % 50, '/', l_orderkey, '/', l_linenumber) AS path", "false AS is_dir", "CAST(l_quantity AS BIGINT) AS mtime", "CAST(floor(l_extendedprice) AS BIGINT) AS size", "CAST(NULL AS STRING) AS identity")
    scan = s.where("id % 13 > 0").selectExpr("CASE WHEN id % 31 = 0 THEN concat(path, 'n') ELSE path END AS path", "is_dir", "CASE WHEN id % 7 = 0 THEN mtime + 1 ELSE mtime END AS mtime", "size", "CASE WHEN id % 3 = 0 THEN 'x' END AS identity")
    return s, scan


@query(f"""WITH {SAVED}, {SCAN} SELECT coalesce(s.path, n.path) AS path, s.id, CASE WHEN s.id IS NULL THEN 'new' WHEN n.path IS NULL THEN 'unseen' WHEN s.mtime <> n.mtime OR s.size <> n.size OR n.identity IS NOT NULL THEN 'metadata' ELSE 'same' END AS verdict FROM saved s FULL JOIN scan n ON s.path = n.path""")
def store_diff(spark, d):
    return store.diff(*_saved(spark, d))


@query(f"""WITH {SAVED}, {SCAN}, n AS (SELECT s.id, coalesce(s.path, n.path) AS path, coalesce(n.mtime, s.mtime) AS mtime, n.identity FROM saved s FULL JOIN scan n ON s.path = n.path)
  SELECT path, mtime, identity, coalesce(id, (SELECT max(id) FROM saved) + row_number() OVER (PARTITION BY id IS NULL ORDER BY path)) AS id FROM n""")
def store_upsert(spark, d):
    return store.upserted(*_saved(spark, d)).select("path", "mtime", "identity", "id")


@query(f"""WITH {SAVED}, {SCAN}, kept AS (SELECT DISTINCT '/o/' || k || '/' || (k + 50 * j) AS path FROM (SELECT unnest(range(0, 5)) AS k), (SELECT unnest(range(0, 400)) AS j))
  SELECT id, path FROM saved s WHERE NOT (starts_with(path, '/o/') AND path NOT IN (SELECT path FROM scan) AND regexp_replace(path, '/[^/]*$', '') NOT IN (SELECT path FROM kept) AND NOT starts_with(path, '/o/7/'))""")
def store_prune_kept(spark, d):
    saved, scan = _saved(spark, d)
    kept = spark.range(5).withColumnRenamed("id", "k").crossJoin(spark.range(400).withColumnRenamed("id", "j")).selectExpr("concat('/o/', k, '/', k + 50 * j) AS path")
    roots = spark.createDataFrame([("/o",), ("/o/7",)], "path string")
    return store.pruned(saved, scan, "/o", kept, roots).select("id", "path")


@query(f"""WITH {SAVED}, {SCAN} SELECT id, path FROM saved WHERE NOT starts_with(path, '/o/') OR split_part(path, '/', 3) IN (SELECT split_part(path, '/', 3) FROM saved WHERE id % 3 = 0 AND CAST(split_part(path, '/', 3) AS INT) % 4 > 0)""")
def store_prune_children(spark, d):
    saved, _ = _saved(spark, d)
    seen = saved.where("id % 3 = 0 AND CAST(split_part(path, '/', 3) AS INT) % 4 > 0").selectExpr("concat('/o/', split_part(path, '/', 3)) AS path").distinct()
    return store.pruned_children(saved, seen, "/o").select("id", "path")


@query(f"""WITH {SAVED} SELECT id, CASE WHEN starts_with(path, '/o/3/') THEN '/o/9/' || substr(path, 6) ELSE path END AS path FROM (SELECT * FROM saved UNION ALL SELECT 0, '/o/3', true, 0, 0, NULL) WHERE path <> '/o/3' AND NOT starts_with(path, '/o/9/') UNION ALL SELECT 0, '/o/9'""")
def store_move(spark, d):
    saved, _ = _saved(spark, d)
    rows = saved.union(spark.sql("SELECT 0L, '/o/3', true, 0L, 0L, CAST(NULL AS STRING)"))
    return store.moved(rows, "/o/3", "/o/9").select("id", "path")


@query(f"""WITH {SAVED}, n AS (SELECT id + CASE WHEN id % 17 = 0 THEN 100000000 ELSE 0 END AS id, CASE WHEN id % 5 = 0 THEN path || 'x' ELSE path END AS path, mtime + id % 2 AS mtime, size FROM saved)
  SELECT coalesce(s.id, n.id) AS id, CASE WHEN s.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'deleted' WHEN s.path <> n.path THEN 'updated' ELSE 'metadata' END AS kind FROM saved s FULL JOIN n USING (id) WHERE s.id IS NULL OR n.id IS NULL OR s.path <> n.path OR s.mtime <> n.mtime""")
def store_changes(spark, d):
    saved, _ = _saved(spark, d)
    after = saved.selectExpr("id + CASE WHEN id % 17 = 0 THEN 100000000 ELSE 0 END AS id", "CASE WHEN id % 5 = 0 THEN concat(path, 'x') ELSE path END AS path", "is_dir", "mtime + id % 2 AS mtime", "size", "identity")
    return store.changes(saved, after)


@query(f"WITH {SAVED} SELECT count(*) AS n_rows, 0::BIGINT AS n_dirs, CAST(sum(size) AS BIGINT) AS bytes, max(length(path)) AS longest_path FROM saved")
def store_stats(spark, d):
    return store.statistics(_saved(spark, d)[0])


# --- evaluation --------------------------------------------------------------------------------------------

RES = "res AS (SELECT o_custkey AS query_id, o_orderkey AS entry_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), tgt AS (SELECT o_custkey AS query_id, max(o_orderkey) AS entry_id FROM orders GROUP BY ALL)"


def _results(spark, d):
    from pyspark.sql import Window as W

    o = _t(spark, d, "orders")
    res = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("entry_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    return res, o.groupBy(F.col("o_custkey").alias("query_id")).agg(F.max("o_orderkey").alias("entry_id")), o


@query(f"""WITH {RES}, b AS (SELECT t.query_id, min(rank) AS rank FROM tgt t LEFT JOIN (SELECT * FROM res WHERE rank <= 20) r ON r.query_id = t.query_id AND r.entry_id = t.entry_id GROUP BY ALL)
  SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(CASE WHEN rank <= 1000 THEN 1.0 ELSE 0.0 END), 6) AS candidate_recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(rank) AS found FROM b""")
def eval_recall_mrr(spark, d):
    res, tgt, _ = _results(spark, d)
    out = evaluation.known_item(res.where("rank <= 20"), tgt)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_5", "recall_at_10", "candidate_recall", "mrr")], "found")


@query(f"""WITH {RES}, g AS (SELECT o_custkey AS query_id, o_orderkey AS entry_id, CAST(o_orderkey % 4 AS INT) AS grade FROM orders WHERE o_orderkey % 4 > 0),
  a AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM res JOIN g USING (query_id, entry_id) WHERE rank <= 10 GROUP BY ALL),
  i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, entry_id) AS r FROM g) WHERE r <= 10 GROUP BY ALL)
  SELECT query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM i LEFT JOIN a USING (query_id)""")
def eval_ndcg(spark, d):
    res, _, o = _results(spark, d)
    g = o.where("o_orderkey % 4 > 0").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("entry_id"), (F.col("o_orderkey") % 4).cast("int").alias("grade"))
    return evaluation.ndcg(res, g).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY ALL")
def eval_percentiles(spark, d):
    return evaluation.percentiles(_t(spark, d, "events"), "value", ["event_type"])


@query(f"""WITH {PARTS}, {_words([(1, 'red widget'), (2, 'promo'), (3, 'blue 12')])}, f AS (SELECT entry_id, name AS text, 3.0::DOUBLE AS weight FROM parts UNION ALL SELECT entry_id, p_type, 1.5 FROM parts),
  e AS (SELECT entry_id, weight, lower(unnest({_tok('text')})) AS word FROM f), tf AS (SELECT entry_id, word, sum(weight) AS tf FROM e GROUP BY ALL), sz AS (SELECT entry_id, sum(tf) AS size FROM tf GROUP BY ALL), st AS (SELECT count(*) AS docs, avg(size) AS mean FROM sz), df AS (SELECT word, count(*) AS df FROM tf GROUP BY ALL)
  SELECT query_id, entry_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM words JOIN df USING (word) JOIN tf USING (word) JOIN sz USING (entry_id), st GROUP BY ALL""")
def eval_bm25(spark, d):
    p = parts(spark, d)
    f = p.select("entry_id", F.col("name").alias("text"), F.lit(3.0).alias("weight")).union(_t(spark, d, "part").select("p_partkey", "p_type", F.lit(1.5)))
    return evaluation.bm25(_asked(spark, [(1, "red widget"), (2, "promo"), (3, "blue 12")]), f).select("query_id", "entry_id", F.round("score", 6).alias("score"))


@query(f"""WITH {PARTS}, p AS (SELECT entry_id, norm, length(norm) AS n, lower(p_brand) AS up, (entry_id * 7919 + 13) % greatest(length(norm) - 1, 1) + 1 AS k FROM parts WHERE length(norm) >= 4),
  s AS (SELECT *, substr(norm, 1, k - 1) || substr(norm, k + 1, 1) || substr(norm, k, 1) || substr(norm, k + 2) AS swapped FROM p)
  SELECT entry_id, 'exact' AS kind, norm AS text FROM s UNION ALL SELECT entry_id, 'prefix', left(norm, CAST(ceil(n * 0.6) AS INT)) FROM s UNION ALL SELECT entry_id, 'abbreviation', left(norm, 1) || regexp_replace(substr(norm, 2), '[^b-df-hj-np-tv-z]', '', 'g') FROM s
  UNION ALL SELECT entry_id, 'typo', swapped FROM s UNION ALL SELECT entry_id, 'partial_typo', left(swapped, CAST(ceil(n * 0.7) AS INT)) FROM s UNION ALL SELECT entry_id, 'parent', up || ' ' || left(norm, 4) FROM s""")
def eval_known_items(spark, d):
    return evaluation.generated(parts(spark, d))


# --- streams, in their batch form --------------------------------------------------------------------------

EV = "ev AS (SELECT event_id AS seq, ts, ['moved_from', 'moved_to', 'create', 'delete', 'attrib'][1 + event_id % 5] AS kind, '/u/' || user_id || '/' || event_id % 40 || '/f' || event_id AS path, event_id // 5 AS cookie, event_id % 10 = 2 AS is_dir, user_id FROM events)"


def _events(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("moved_from", "moved_to", "create", "delete", "attrib")])
    return _t(spark, d, "events").select(F.col("event_id").alias("seq"), "ts", F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("kind"), F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 40).cast("string"), F.lit("/f"), F.col("event_id").cast("string")).alias("path"), F.expr("event_id div 5").alias("cookie"), (F.col("event_id") % 10 == 2).alias("is_dir"), F.col("user_id").cast("string").alias("root"))


@query(f"WITH {EV} SELECT a.cookie, a.path AS old_path, b.path AS new_path, b.is_dir FROM ev a JOIN ev b ON a.cookie = b.cookie AND a.kind = 'moved_from' AND b.kind = 'moved_to' AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTES AND a.ts + INTERVAL 10 MINUTES")
def stream_rename_pair(spark, d):
    return stream.renames(_events(spark, d), "10 minutes")


@query(f"""WITH {EV}, s AS (SELECT regexp_replace(path, '/[^/]*$', '') AS scope, false AS r FROM ev UNION ALL SELECT path, true FROM ev WHERE kind IN ('create', 'moved_to') AND is_dir)
  SELECT scope, max(r) AS recursive FROM s GROUP BY ALL""")
def stream_scopes(spark, d):
    return stream.scopes(_events(spark, d))


@query(f"""WITH {EV}, m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 100 MILLISECONDS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS g FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)), b AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, seq) AS n FROM m)
  SELECT CAST(user_id AS VARCHAR) AS root, min(ts) AS batch_start, count(*) AS n_events FROM b GROUP BY user_id, n""")
def stream_debounce(spark, d):
    return stream.debounced(_events(spark, d)).select("root", "batch_start", "n_events")


@query("""SELECT user_id AS window_id, max(CASE WHEN event_type = 'view' THEN event_id END) AS activated, arg_max(event_type, event_id) AS title FROM events GROUP BY ALL HAVING arg_max(event_type, event_id) <> 'error'""")
def window_activity(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("window_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "activate").when(F.col("event_type") == "error", "close").otherwise("title").alias("event"), F.col("event_type").alias("title"))
    return stream.last_active(e)


# --- scalars and sources -----------------------------------------------------------------------------------


@query("SELECT DISTINCT p_brand, 'https://duckduckgo.com/?q=' || url_encode(p_brand || ' ~*/' || p_name) AS url FROM part")
def scalar_search_url(spark, d):
    return _t(spark, d, "part").select("p_brand", scalars.search_url(F.lit("duckduckgo"), F.concat("p_brand", F.lit(" ~*/"), "p_name")).alias("url")).distinct()


@query("""SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS text, true AS is_address, regexp_matches(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[/?#].*$', ''), '[.](com|org|net)$') AS without_scheme FROM pages""")
def scalar_web_address(spark, d):
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    return _t(spark, d, "pages").select("page_id", bare.alias("text"), scalars.web_address(F.col("url")).alias("is_address"), scalars.web_address(bare).alias("without_scheme"))


@query("""WITH q AS (SELECT p_partkey, ['web ', 'Install ', 'local', ''][1 + p_partkey % 4] || CASE WHEN p_partkey % 4 = 2 THEN '' ELSE ' ' END || p_name AS text FROM part)
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'install' END AS mode, CASE WHEN p_partkey % 4 < 2 THEN trim(regexp_replace(text, '^\\s*\\w+\\s+', '')) ELSE text END AS rest FROM q""")
def scalar_mode(spark, d):
    pre = F.element_at(F.array(F.lit("web "), F.lit("Install "), F.lit("local"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(pre, F.when(F.col("p_partkey") % 4 == 2, "").otherwise(" "), "p_name")
    return _t(spark, d, "part").withColumn("text", text).select("p_partkey", scalars.mode(F.col("text")).alias("mode"), scalars.mode_rest(F.col("text")).alias("rest"))


@query(f"""WITH {FILES} SELECT entry_id, translate(regexp_replace(array_to_string(string_split(path, '/')[-3:], '/'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '/_-.', '    ') AS text FROM files""")
def scalar_embedding_text(spark, d):
    return files(spark, d).select("entry_id", scalars.embedding_text(F.col("path")).alias("text"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS request_id, event_type AS op, CASE WHEN event_id % 3 = 0 THEN false ELSE true END AS valid FROM events""")
def request_decode(spark, d):
    line = F.concat(F.lit('{"version": 1, "op": "'), "event_type", F.lit('", "request_id": '), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 3 == 0, ', "extra": 1').otherwise(""), F.lit("}"))
    rows = _t(spark, d, "events").select(F.concat(F.substring(line, 1, 1), F.lit('"limit": '), F.col("event_id").cast("string"), F.lit(", "), F.substring(line, 2, 1000)).alias("value"))
    return listings.requests(rows).select(F.col("limit").cast("long").alias("event_id"), "request_id", "op", "valid")


@query("""SELECT s_suppkey AS mount_id, CAST(s_nationkey AS VARCHAR) AS device, '/mnt/' || s_name || ' x' AS mount_point, s_nationkey % 2 = 0 AS reliable FROM supplier""")
def mount_parse(spark, d):
    line = F.concat(F.col("s_suppkey").cast("string"), F.lit(" 1 "), F.col("s_nationkey").cast("string"), F.lit(" / /mnt/"), "s_name", F.lit("\\040x rw - "), F.when(F.col("s_nationkey") % 2 == 0, "ext4").otherwise("fuse.sshfs"), F.lit(" dev rw"))
    m = listings.mounts(_t(spark, d, "supplier").select(line.alias("value")))
    return m.select(F.col("mount_id").cast("long").alias("mount_id"), "device", "mount_point", "reliable")


@query("""SELECT 'app' || p_partkey || '.desktop' AS desktop_id, p_name AS name, p_brand AS generic_name, p_type = 'PROMO' AS settings FROM part WHERE p_partkey % 10 <> 4""")
def desktop_discovery(spark, d):
    body = F.concat(F.lit("[Desktop Entry]\nType=Application\nName="), "p_name", F.lit("\nGenericName="), "p_brand", F.lit("\nCategories=X;"), F.when(F.col("p_type") == "PROMO", "Settings;").otherwise(""), F.when(F.col("p_partkey") % 10 == 4, "\nNoDisplay=true").otherwise(""), F.lit("\n[Other]\nName=no\n"))
    p = _t(spark, d, "part").select(F.concat(F.lit("app"), F.col("p_partkey").cast("string"), F.lit(".desktop")).alias("desktop_id"), F.lit(0).alias("precedence"), body.alias("content"))
    masked = p.withColumn("precedence", F.lit(1)).withColumn("content", F.lit("[Desktop Entry]\nName=later\n"))
    return listings.desktop_entries(p.unionByName(masked)).select("desktop_id", "name", "generic_name", "settings")


@query("""SELECT 'org.' || replace(p_type, ' ', '') || '.App' || p_partkey AS app_id, p_name AS name, 'system' AS installation FROM part WHERE p_partkey % 6 <> 1""")
def package_listing(spark, d):
    ref = F.concat(F.lit("app/"), F.when(F.col("p_partkey") % 6 == 1, "bad").otherwise(F.concat(F.lit("org."), "p_type", F.lit(".App"), F.col("p_partkey").cast("string"))), F.lit("/x86_64/stable"))
    rows = listings.packages(_t(spark, d, "part").select(F.concat(ref, F.lit("\t"), "p_name", F.lit("\tsummary")).alias("value")), "system")
    return rows.select("ref.app_id", "name", "ref.installation")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Doc ' || event_id WHEN 1 THEN 'a - b' ELSE 'Doc - ' || event_type END AS title FROM events""")
def scalar_short_title(spark, d):
    app = F.initcap(F.concat("event_type", F.lit(" Studio")))
    title = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Doc "), F.col("event_id").cast("string"), F.lit(" \u2014 "), app)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("a - b - "), F.upper("event_type"))).otherwise(F.concat(F.lit("Doc - "), "event_type"))
    full = F.when(F.col("event_id") % 4 > 1, F.lit("Other")).otherwise(app)
    return _t(spark, d, "events").select("event_id", scalars.short_title(title, full).alias("title"))


@query("""SELECT 'key_' || chr(CAST(97 + p_partkey % 26 AS INT)) AS key, CASE WHEN p_partkey % 2 = 0 THEN '/home/u/' || p_name ELSE p_name END AS value, true AS valid FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT 'Bad', p_name, false FROM part WHERE p_partkey % 5 = 0""")
def config_lines(spark, d):
    key = F.when(F.col("p_partkey") % 5 == 0, "Bad").otherwise(F.concat(F.lit("key_"), F.chr(F.lit(97) + F.col("p_partkey") % 26)))
    value = F.concat(F.when((F.col("p_partkey") % 2 == 0) & (F.col("p_partkey") % 5 > 0), "~/").otherwise(""), "p_name")
    rows = _t(spark, d, "part").select(F.concat(F.lit("  "), key, F.lit(" = "), value, F.lit(" ")).alias("value"))
    return listings.config(rows.union(spark.createDataFrame([("# comment",), ("",)], "value string")), "/home/u")


@query("""SELECT user_id AS client, max(event_id) AS seq, arg_max(event_type, event_id) AS op FROM events GROUP BY ALL""")
def newest_requests(spark, d):
    return stream.newest_requests(_t(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), F.col("event_type").alias("op")))


@query(f"WITH {SAVED} SELECT '{{\"n_rows\":' || count(*) || ',\"n_dirs\":0,\"bytes\":' || CAST(sum(size) AS BIGINT) || ',\"n_opens\":' || (SELECT count(*) FROM events) || ',\"last_open\":' || (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) FROM events) || '}}' AS value FROM saved")
def status_report(spark, d):
    return store.status(_saved(spark, d)[0], _t(spark, d, "events").select(F.unix_timestamp("ts").alias("ts")))
