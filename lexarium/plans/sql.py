"""The queries of plans/queries.py as DuckDB SQL, built from the same tables of fixed values."""

from __future__ import annotations

from lexarium.functions.text import PUNCTUATION, TOKEN, WHITE_SPACE
from lexarium.plans.settings import CORPUS, FIXED_STEPS, LETTERS, ROW_WORD, TARGETS, TEXT, TOP, WANTED_PAIRS, WANTED_WORDS, WINDOW
from lexarium.sources.stop_words import STOP_WORDS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


STOP, PUNCT = listed(STOP_WORDS), listed(["", *PUNCTUATION])


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {quoted(TOKEN)}, 0, 's')"


def plain(t: str) -> str:
    """Without 's, commas, full stops and blanks."""
    return f"translate(replace({t}, '''s', ''), {quoted(',.' + WHITE_SPACE)}, '')"


def words(x: str) -> str:
    return f"list_filter(list_transform({tokens(x)}, lambda t: lower({plain('t')})), lambda w: NOT list_contains({PUNCT}, w) AND NOT list_contains({STOP}, w))"


def sentences(x: str) -> str:
    """Mark every possible end, then take back the marks that rules forbid."""
    line, end = "\x1e", "\x1f"
    steps = (
        (r"(\r\n|[\n\r])", "\n" + line),
        (r'([.!?]["()]*[ \t]*)', r"\1" + end),
        (end + r'(["()]*[ \t]*[.!?,\-:;])', r"\1"),
        (end + r'(["()]*[ \t]*[.!?,\-:;])', r"\1"),
        (r'(\.["()]*[ \t]*)' + end + r"([^\pL\n" + line + end + r".!?]*\p{Ll})", r"\1\2"),
        (r"(\.)" + end + r"(\p{Nd})", r"\1\2"),
        (r"(\pL\.)" + end + r"(\p{Lu})", r"\1\2"),
        (r"(\pL\.)" + end + r"(\p{Lu})", r"\1\2"),  # a match takes the next one's letter with it
    )
    for pattern, new in steps:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return f"list_filter(string_split_regex({x}, '[{line}{end}]'), lambda s: regexp_matches(s, '[\\pL\\pN]'))"


def filter_blank(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


DOCS = "docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
SENTENCES = f"{DOCS}, cut AS (SELECT doc_id, {sentences('text')} AS s FROM docs), each AS (SELECT doc_id, unnest(range(0, len(s))) AS i, unnest(s) AS s FROM cut), sents AS (SELECT doc_id, i, array_to_string({words('s')}, ' ') AS sentence FROM each)"
LINES = (
    f"{DOCS}, line AS (SELECT doc_id, list_filter(string_split_regex(text, '\\r?\\n'), lambda x: regexp_matches(x, '\\S')) AS l FROM docs),"
    "lines AS (SELECT doc_id, unnest(range(0, len(l))) AS p, unnest(l) AS l FROM line),"
    f"cut AS (SELECT doc_id, p, {sentences('l')} AS s FROM lines), each AS (SELECT doc_id, p, unnest(range(0, len(s))) AS i, unnest(s) AS s FROM cut),"
    f"pars AS (SELECT l.doc_id, l.p, coalesce(string_agg(array_to_string({words('s')}, ' '), ' ' ORDER BY i), '') AS paragraph FROM lines l LEFT JOIN each e ON e.doc_id = l.doc_id AND e.p = l.p GROUP BY l.doc_id, l.p)"
)


def phrases(length: int | None = None) -> str:
    """CTEs up to phrase(doc_id, k, words): runs between stop words, cut after ``length`` words."""
    cut = f"(r - 1) // {length}" if length else "0"
    return (
        f"{DOCS}, listed AS (SELECT doc_id, list_filter(list_transform({tokens('text')}, lambda t: lower({plain('t')})), lambda w: NOT list_contains({PUNCT}, w)) AS w FROM docs),"
        "tok AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM listed),"
        f"flag AS (SELECT *, list_contains({STOP}, word) AS stop FROM tok),"
        "isle AS (SELECT *, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isle FROM flag),"
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, isle ORDER BY pos) AS r FROM isle WHERE NOT stop),"
        f"run AS (SELECT doc_id, isle, {cut} AS part, list(word ORDER BY pos) AS words, min(pos) AS spot FROM numbered GROUP BY doc_id, isle, part),"
        "phrase AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS k, words FROM run)"
    )


def tf_idf(segments: str) -> str:
    """segments: CTEs up to seg(corpus, sid, w)."""
    return (
        f"WITH {segments}, size AS (SELECT corpus, count(*) AS n FROM seg GROUP BY corpus),"
        "segtok AS (SELECT corpus, sid, unnest(w) AS word FROM seg), cnt AS (SELECT corpus, word, count(*) AS c, count(DISTINCT sid) AS df FROM segtok GROUP BY corpus, word),"
        "raw AS (SELECT corpus, word, c * (ln((n + 1)::DOUBLE / (df + 1)) + 1) AS v FROM cnt JOIN size USING (corpus)),"
        "scored AS (SELECT corpus, word, round(v / sqrt(sum(v * v) OVER (PARTITION BY corpus)), 6) AS score FROM raw)"
    )


ALL_DOCS = f"{SENTENCES}, joined AS (SELECT d.doc_id, coalesce(string_agg(sentence, ' ' ORDER BY i), '') AS t FROM docs d LEFT JOIN sents s ON s.doc_id = d.doc_id GROUP BY d.doc_id)"
SEG_DOCS = f"{ALL_DOCS}, seg AS (SELECT 0 AS corpus, doc_id AS sid, {filter_blank('t')} AS w FROM joined)"
SEG_RAW = f"{DOCS}, seg AS (SELECT 0 AS corpus, doc_id AS sid, {filter_blank('text')} AS w FROM docs)"
SEG_SENTENCES = f"{SENTENCES}, seg AS (SELECT doc_id AS corpus, i AS sid, {filter_blank('sentence')} AS w FROM sents)"
SEG_PARAGRAPHS = f"{LINES}, seg AS (SELECT doc_id AS corpus, p AS sid, {filter_blank('paragraph')} AS w FROM pars)"
SEG_PHRASES = f"{phrases()}, seg AS (SELECT doc_id AS corpus, k AS sid, words AS w FROM phrase)"

_SPLIT = f"{DOCS}, listed AS (SELECT doc_id, {filter_blank('text')} AS w FROM docs)"
CO = (
    f"{_SPLIT}, allw AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM listed), tok AS (SELECT * FROM allw WHERE list_contains({listed(TARGETS)}, word)),"
    f"cnt AS (SELECT a.word AS word1, b.word AS word2, count(*) AS c FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= {WINDOW} GROUP BY a.word, b.word),"
    "triple AS (SELECT word1, word2, c::DOUBLE / max(c) OVER () AS weight FROM cnt),"
    f"label AS (SELECT unnest(range(0, {len(TARGETS)}))::INT AS label, unnest({listed(TARGETS)}) AS word)"
)


def rake(length: int | None = None) -> str:
    return (
        f"WITH {phrases(length)}, tok2 AS (SELECT doc_id, k, len(words) AS n, array_to_string(words, ' ') AS phrase, unnest(words) AS word FROM phrase),"
        "per AS (SELECT doc_id, word, count(*) AS frequency, sum(n - 1)::BIGINT AS degree, sum(n - 1)::DOUBLE / count(*) AS score FROM tok2 GROUP BY doc_id, word),"
        "scored AS (SELECT doc_id, phrase, k, avg(score) AS score FROM tok2 JOIN per USING (doc_id, word) GROUP BY doc_id, phrase, k),"
        "once AS (SELECT doc_id, phrase, round(min(score), 6) AS score FROM scored GROUP BY doc_id, phrase)"
    )


GRAPH = (
    f"{DOCS}, glisted AS (SELECT doc_id, {words('text')} AS w FROM docs), gtok AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM glisted),"
    "near AS (SELECT a.doc_id, a.word AS x, b.word AS y FROM gtok a JOIN gtok b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 2 WHERE a.word <> b.word),"
    "graph AS (SELECT doc_id, src, dst, count(*) AS weight FROM (SELECT doc_id, x AS src, y AS dst FROM near UNION ALL SELECT doc_id, y, x FROM near) GROUP BY doc_id, src, dst),"
    "outw AS (SELECT doc_id, src AS word, sum(weight)::BIGINT AS out_weight FROM graph GROUP BY doc_id, src)"
)


def text_rank_steps(steps: int) -> str:
    ctes = [GRAPH, "s0 AS (SELECT doc_id, word, 1.0::DOUBLE AS score FROM outw)"]
    for k in range(1, steps + 1):
        ctes.append(f"s{k} AS (SELECT g.doc_id, g.src AS word, 0.15 + 0.85 * sum(g.weight::DOUBLE / o.out_weight * s.score) AS score FROM graph g JOIN outw o ON o.doc_id = g.doc_id AND o.word = g.dst JOIN s{k - 1} s ON s.doc_id = g.doc_id AND s.word = g.dst GROUP BY g.doc_id, g.src)")
    return "WITH " + ", ".join(ctes)


#: The walk of every document until all its changes are below the tolerance; a word's own last score comes along an edge of weight 0.
WALK = (
    "edge AS MATERIALIZED (SELECT g.doc_id, g.src, g.dst, g.weight::DOUBLE / o.out_weight AS share, 0 AS own FROM graph g JOIN outw o ON o.doc_id = g.doc_id AND o.word = g.dst"
    " UNION ALL SELECT doc_id, word, word, 0.0, 1 FROM outw),"
    "walk AS (SELECT doc_id, word, 1.0::DOUBLE AS score, false AS done FROM outw UNION ALL"
    " SELECT doc_id, word, score, max(abs(score - was)) OVER (PARTITION BY doc_id) < 0.00005 AS done FROM"
    " (SELECT e.doc_id, e.src AS word, 0.15 + 0.85 * sum(e.share * w.score) AS score, max(CASE WHEN own = 1 THEN w.score END) AS was FROM walk w JOIN edge e ON e.doc_id = w.doc_id AND e.dst = w.word WHERE NOT w.done GROUP BY e.doc_id, e.src)),"
    "wr AS (SELECT doc_id, word, score FROM walk WHERE done)"
)
TEXT_RANK = f"WITH RECURSIVE {phrases()}, {GRAPH.removeprefix(DOCS + ', ')}, {WALK}, pw AS (SELECT doc_id, k, array_to_string(words, ' ') AS phrase, unnest(words) AS word FROM phrase), pk AS (SELECT p.doc_id, k, phrase, sum(coalesce(score, 0)) / count(*) AS score FROM pw p LEFT JOIN wr ON wr.doc_id = p.doc_id AND wr.word = p.word GROUP BY p.doc_id, k, phrase), pr AS (SELECT doc_id, phrase, min(score) AS score FROM pk GROUP BY doc_id, phrase)"

_YAKE_TEXT = r"regexp_replace(regexp_replace(text, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g'), '[\n\t\r]', ' ', 'g')"
_NUMBER = quoted(r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$")
_INVALID = f"(list_contains({PUNCT}, term) OR list_contains({STOP}, term) OR regexp_matches(term, {_NUMBER}))"
YAKE = (
    f"WITH {DOCS}, cut AS (SELECT doc_id, {sentences(_YAKE_TEXT)} AS s FROM docs), each AS (SELECT doc_id, len(s) AS ns, unnest(range(0, len(s))) AS i, unnest(s) AS s FROM cut),"
    f"toks AS (SELECT doc_id, ns, i, list_filter(list_transform({tokens('s')}, lambda t: {plain('t')}), lambda w: w <> '') AS w FROM each),"
    "tok0 AS (SELECT doc_id, ns, i, unnest(range(0, len(w))) AS j, unnest(w) AS surface FROM toks), tok1 AS (SELECT *, lower(surface) AS term FROM tok0),"
    f"tok AS (SELECT *, NOT {_INVALID} AS valid FROM tok1),"
    "g1 AS (SELECT doc_id, term AS keyword, 1 AS n FROM tok WHERE valid),"
    "g2 AS (SELECT a.doc_id, a.term || ' ' || b.term AS keyword, 2 AS n FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.i = b.i AND b.j = a.j + 1 WHERE a.valid AND b.valid),"
    "g3 AS (SELECT a.doc_id, a.term || ' ' || b.term || ' ' || c.term AS keyword, 3 AS n FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.i = b.i AND b.j = a.j + 1 JOIN tok c ON a.doc_id = c.doc_id AND a.i = c.i AND c.j = a.j + 2 WHERE a.valid AND b.valid AND c.valid),"
    "cand AS (SELECT doc_id, keyword, n, count(*) AS tf FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3) GROUP BY doc_id, keyword, n),"
    "lefts AS (SELECT a.doc_id, a.term, count(*) AS lc, count(DISTINCT b.surface) AS ld FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.i = b.i AND a.j - b.j BETWEEN 1 AND 2 WHERE a.valid GROUP BY a.doc_id, a.term),"
    "rights AS (SELECT a.doc_id, a.term, count(*) AS rc, count(DISTINCT b.surface) AS rd FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.i = b.i AND b.j - a.j BETWEEN 1 AND 2 WHERE a.valid GROUP BY a.doc_id, a.term),"
    "stat AS (SELECT doc_id, term, max(ns) AS ns, count(*) AS tf, sum(CASE WHEN length_grapheme(surface) > 1 AND upper(surface) = surface THEN 1 ELSE 0 END) AS up,"
    r"sum(CASE WHEN regexp_matches(surface, '^\p{Lu}(\p{M}*|.*\p{Ll}.*)$', 's') THEN 1 ELSE 0 END) AS cap, list(i ORDER BY i) AS o, count(DISTINCT i) AS us FROM tok WHERE valid GROUP BY doc_id, term),"
    "ctx AS (SELECT s.*, coalesce(lc, 0) AS lc, coalesce(ld, 0) AS ld, coalesce(rc, 0) AS rc, coalesce(rd, 0) AS rd FROM stat s LEFT JOIN lefts l ON l.doc_id = s.doc_id AND l.term = s.term LEFT JOIN rights r ON r.doc_id = s.doc_id AND r.term = s.term),"
    "m AS (SELECT *, sum(tf) OVER d / (count(*) OVER d + e) AS mean, max(tf) OVER d AS most FROM ctx, (SELECT pow(2, -23) AS e) WINDOW d AS (PARTITION BY doc_id)),"
    "st AS (SELECT *, sqrt(sum((tf - mean) * (tf - mean)) OVER (PARTITION BY doc_id)) AS std FROM m),"
    "f AS (SELECT *, greatest(up, cap) / (1 + ln(tf)) AS casing, tf / (mean + std + e) AS freq, 1 + (ld / (lc + e) + rd / (rc + e)) * tf / most AS rel, us / (ns + e) AS spread,"
    "CASE WHEN len(o) = 1 THEN o[1] WHEN len(o) % 2 = 0 THEN o[len(o) // 2 + 1] ELSE (o[len(o) // 2 + 1] + o[len(o) // 2]) / 2.0 END AS median FROM st),"
    "wt AS (SELECT doc_id, term, rel * ln(ln(3 + median)) / (casing + freq / rel + spread / rel) AS weight FROM f),"
    "ct AS (SELECT doc_id, keyword, n, tf, unnest(string_split(keyword, ' ')) AS term FROM cand),"
    "dd AS (SELECT doc_id, term, count(*) AS dedup FROM ct WHERE n > 1 GROUP BY doc_id, term),"
    "kw AS (SELECT c.doc_id, c.keyword, c.n, c.tf, product(weight) AS prod, sum(weight) AS total FROM ct c JOIN wt w ON w.doc_id = c.doc_id AND w.term = c.term GROUP BY c.doc_id, c.keyword, c.n, c.tf),"
    "kr AS (SELECT k.doc_id, k.keyword, k.tf * (1 + total) / (coalesce(dedup, 1) * prod) AS raw FROM kw k LEFT JOIN dd ON k.n = 1 AND dd.doc_id = k.doc_id AND dd.term = k.keyword),"
    "ks AS (SELECT doc_id, keyword, raw / greatest(pow(2, -23), max(raw) OVER (PARTITION BY doc_id)) AS score FROM kr)"
)


#: The greedy choice: keyword by keyword, in order, until TOP are kept; letters beyond ASCII become one byte each.
YAKE_TOP = (
    YAKE.replace("WITH ", "WITH RECURSIVE ", 1) + f", folded AS MATERIALIZED (SELECT *, translate(keyword, {quoted(LETTERS)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS plain FROM ("
    "SELECT doc_id, keyword, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, keyword) AS r FROM ks)),"
    "pick AS (SELECT DISTINCT doc_id, 0::BIGINT AS r, CAST([] AS VARCHAR[]) AS kept, false AS fresh FROM folded UNION ALL SELECT doc_id, r, CASE WHEN fresh THEN list_append(kept, plain) ELSE kept END, fresh FROM"
    " (SELECT p.doc_id, f.r, p.kept, f.plain, len(list_filter(p.kept, lambda x: 1 - levenshtein(x, f.plain)::DOUBLE / greatest(length(x), length(f.plain)) >= 0.85)) = 0 AS fresh"
    f" FROM pick p JOIN folded f ON f.doc_id = p.doc_id AND f.r = p.r + 1 WHERE len(p.kept) < {TOP}))"
)


def looked_up(source: str, key: str, digits: int = 6) -> str:
    """source(doc_id, key, score): the score of each wanted word in each document."""
    return f" SELECT a.doc_id, a.{key}, round(coalesce(s.score, 0), {digits}) AS score FROM (SELECT doc_id, unnest({listed(WANTED_WORDS)}) AS {key} FROM documents) a LEFT JOIN ({source}) s ON s.doc_id = a.doc_id AND s.{key} = a.{key}"


def flat(source: str, key: str, digits: int = 6) -> str:
    """source(doc_id, key, score) as one text for each document."""
    return (
        f" SELECT d.doc_id, coalesce(string_agg(s.{key} || printf('=%.{digits}f', round(s.score, {digits})), ';' ORDER BY s.{key}), '') AS {key}_scores"
        f" FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN ({source}) s ON s.doc_id = d.doc_id GROUP BY d.doc_id"
    )


TERM_SCORES = "SELECT doc_id, term, (1 / weight) / greatest(pow(2, -23), max(1 / weight) OVER (PARTITION BY doc_id)) AS score FROM wt"
_TEXTS = f"(SELECT unnest(range(0, {len(CORPUS)})) AS doc_id, unnest({listed(CORPUS)}) AS text)"


def top(source: str, key: str, by: str = "PARTITION BY doc_id", keep: str = "doc_id, ") -> str:
    return f" SELECT {keep}{key}, score, rank FROM (SELECT *, CAST(row_number() OVER ({by} ORDER BY score DESC, {key}) AS INT) AS rank FROM ({source})) WHERE rank <= {TOP}"


QUERIES: dict[str, str] = {
    "words": f"WITH {DOCS}, listed AS (SELECT doc_id, {words('text')} AS w FROM docs) SELECT doc_id, unnest(range(0, len(w)))::INT AS pos, unnest(w) AS word FROM listed",
    "word_counts": f"WITH {DOCS}, tok AS (SELECT unnest({words('text')}) AS word FROM docs) SELECT word, count(*) AS n FROM tok GROUP BY word",
    "sentences": f"WITH {SENTENCES} SELECT doc_id, i::INT AS sent_idx, sentence FROM sents",
    "paragraphs": f"WITH {LINES} SELECT doc_id, p::INT AS par_idx, paragraph FROM pars",
    "phrases": f"WITH {phrases()} SELECT doc_id, k::INT AS phrase_idx, array_to_string(words, ' ') AS phrase FROM phrase",
    "phrases_len3": f"WITH {phrases(3)} SELECT doc_id, k::INT AS phrase_idx, array_to_string(words, ' ') AS phrase FROM phrase",
    "processed_documents": f"WITH {ALL_DOCS} SELECT doc_id, t AS text FROM joined",
    "tfidf_corpus": tf_idf(SEG_DOCS) + " SELECT word, score FROM scored",
    "tfidf_processed": tf_idf(SEG_RAW) + " SELECT word, score FROM scored",
    "tfidf_sentences": tf_idf(SEG_SENTENCES) + " SELECT corpus AS doc_id, word, score FROM scored",
    "tfidf_paragraphs": tf_idf(SEG_PARAGRAPHS) + " SELECT corpus AS doc_id, word, score FROM scored",
    "tfidf_phrases": tf_idf(SEG_PHRASES) + " SELECT corpus AS doc_id, word, score FROM scored",
    "tfidf_top_n": tf_idf(SEG_DOCS) + top("SELECT word, score FROM scored", "word", "", ""),
    "cooccur_triples": f"WITH {CO} SELECT word1, word2, round(weight, 6) AS weight FROM triple",
    "cooccur_matrix": f"WITH {CO} SELECT a.label AS \"row\", b.label AS col, a.word AS word1, b.word AS word2, round(coalesce(weight, 0), 6) AS weight FROM label a CROSS JOIN label b LEFT JOIN triple t ON t.word1 = a.word AND t.word2 = b.word",
    "cooccur_row": f"WITH {CO} SELECT {quoted(ROW_WORD)} AS word, array_to_string(list(printf('%.4f', coalesce(weight, 0)) ORDER BY b.label), ' ') AS weights FROM label b LEFT JOIN triple t ON t.word1 = {quoted(ROW_WORD)} AND t.word2 = b.word",
    "cooccur_relations": f"WITH {CO} SELECT word2 AS word, round(weight, 6) AS weight, label FROM triple JOIN label ON label.word = word2 WHERE word1 = {quoted(ROW_WORD)}",
    "rake_words": rake() + " SELECT doc_id, word, frequency, degree, round(score, 6) AS score FROM per",
    "rake_phrases": rake() + " SELECT doc_id, phrase, score FROM once",
    "rake_len3": rake(3) + " SELECT doc_id, phrase, score FROM once",
    "rake_top_n": rake() + top("SELECT * FROM once", "phrase"),
    "textrank_graph": f"WITH {GRAPH} SELECT doc_id, src, dst, weight FROM graph",
    "textrank_out_weights": f"WITH {GRAPH} SELECT doc_id, word, out_weight FROM outw",
    "textrank_fixed_iter": text_rank_steps(FIXED_STEPS) + f" SELECT doc_id, word, round(score, 6) AS score FROM s{FIXED_STEPS}",
    "yake_candidates": YAKE + " SELECT doc_id, keyword, n, tf FROM cand",
    "yake_contexts": YAKE + " SELECT doc_id, term, lc::INT AS left_count, ld::INT AS left_distinct, rc::INT AS right_count, rd::INT AS right_distinct FROM ctx",
    "yake_term_scores": YAKE + " SELECT doc_id, term, round((1 / weight) / greatest(pow(2, -23), max(1 / weight) OVER (PARTITION BY doc_id)), 6) AS score FROM wt",
    "tfidf_word_score": tf_idf(SEG_DOCS) + f" SELECT a.word, coalesce(score, 0) AS score FROM (SELECT unnest({listed(WANTED_WORDS)}) AS word) a LEFT JOIN scored s ON s.word = a.word",
    "tfidf_map": tf_idf(SEG_SENTENCES) + flat("SELECT corpus AS doc_id, word, score FROM scored", "word"),
    "tfidf_sentences_top_n": tf_idf(SEG_SENTENCES) + top("SELECT corpus AS doc_id, word, score FROM scored", "word"),
    "text_source_words": f"SELECT 0::BIGINT AS doc_id, unnest(range(0, len(w)))::INT AS pos, unnest(w) AS word FROM (SELECT {words(quoted(TEXT))} AS w)",
    "corpus_source_documents": f"WITH {ALL_DOCS.replace('FROM documents', f'FROM {_TEXTS}', 1)} SELECT doc_id, t AS text FROM joined",
    "cooccur_labels": f"WITH {CO} SELECT word, label FROM label",
    "cooccur_relation": f"WITH {CO} SELECT a[1] AS word1, a[2] AS word2, round(coalesce(weight, 0), 6) AS weight FROM (SELECT unnest([{', '.join(map(listed, WANTED_PAIRS))}]) AS a) LEFT JOIN triple t ON t.word1 = a[1] AND t.word2 = a[2]",
    "rake_words_top_n": rake() + top("SELECT doc_id, word, round(score, 6) AS score FROM per", "word"),
    "rake_word_score": rake() + looked_up("SELECT * FROM per", "word"),
    "rake_phrase_score": rake() + looked_up("SELECT * FROM once", "phrase"),
    "rake_word_map": rake() + flat("SELECT * FROM per", "word"),
    "rake_phrase_map": rake() + flat("SELECT * FROM once", "phrase"),
    "textrank_words": TEXT_RANK + " SELECT doc_id, word, round(score, 4) AS score, true AS converged FROM wr",
    "textrank_phrases": TEXT_RANK + " SELECT doc_id, phrase, round(score, 4) AS score, true AS converged FROM pr",
    "textrank_words_top_n": TEXT_RANK + top("SELECT doc_id, word, round(score, 6) AS score FROM wr", "word", keep="true AS converged, doc_id, "),
    "textrank_phrases_top_n": TEXT_RANK + top("SELECT doc_id, phrase, round(score, 6) AS score FROM pr", "phrase", keep="true AS converged, doc_id, "),
    "textrank_word_score": TEXT_RANK + looked_up("SELECT * FROM wr", "word", 4),
    "textrank_phrase_score": TEXT_RANK + looked_up("SELECT * FROM pr", "phrase", 4),
    "textrank_word_map": TEXT_RANK + flat("SELECT * FROM wr", "word", 4),
    "textrank_phrase_map": TEXT_RANK + flat("SELECT * FROM pr", "phrase", 4),
    "yake_top_n": YAKE_TOP + " SELECT f.doc_id, f.keyword, f.score, CAST(len(p.kept) AS INT) AS rank FROM pick p JOIN folded f ON f.doc_id = p.doc_id AND f.r = p.r WHERE p.fresh",
    "yake_terms_top_n": YAKE + top(f"SELECT doc_id, term, round(score, 6) AS score FROM ({TERM_SCORES})", "term"),
    "yake_keyword_score": YAKE + looked_up("SELECT * FROM ks", "keyword"),
    "yake_term_score": YAKE + looked_up(TERM_SCORES, "term"),
    "yake_keyword_map": YAKE + flat("SELECT * FROM ks", "keyword"),
    "yake_term_map": YAKE + flat(TERM_SCORES, "term"),
    "yake_keyword_scores": YAKE + " SELECT doc_id, keyword, round(score, 6) AS score FROM ks",
    "levenshtein_ratio": "SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)), 6) AS ratio FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
}
