"""The registered queries of this subpackage, and their SQL where SQL can express them."""

import functools

from palim.llm.conversation_repair import op11_conversation_repair
from palim.llm.conversation_sql import op11_sql
from palim.llm.decontamination import op4_template_decontamination
from palim.llm.language import op2_language_id
from palim.llm.language_model import op6_elias_fano_lm
from palim.llm.near_dedup import op10_simhash_bk_tree
from palim.llm.quality import op3_quality_subwords
from palim.llm.ranked_search import op12_threshold_search
from palim.llm.sentencepiece_codec import op7_sentencepiece
from palim.llm.sharding import op9_kd_sharding
from palim.llm.substring_dedup import op8_substring_dedup
from palim.llm.suffix_dedup import op13_suffix_dedup
from palim.llm.syncmers import op1_syncmer_fingerprints
from palim.llm.toxicity import op5_toxicity_trees
from palim.shipping import ship


def _shipped(query):
    """The query, with this package on the executors first."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_syncmer_fingerprints": op1_syncmer_fingerprints,
    "op2_language_id": op2_language_id,
    "op3_quality_subwords": op3_quality_subwords,
    "op4_template_decontamination": op4_template_decontamination,
    "op5_toxicity_trees": op5_toxicity_trees,
    "op6_elias_fano_lm": op6_elias_fano_lm,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_kd_sharding": op9_kd_sharding,
    "op10_simhash_bk_tree": op10_simhash_bk_tree,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_threshold_search": op12_threshold_search,
    "op13_suffix_dedup": op13_suffix_dedup,
}

QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}

#: Windows of 13 words by their text; a word goes if an earlier document starts a window that covers it.
_OP8_SQL = r"""WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM worded)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT x.doc_id, unnest(range(x.i, x.i + 13)) AS p FROM windows x JOIN firsts USING (s) WHERE first < x.doc_id)),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS k, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM worded) t ANTI JOIN gone ON gone.doc_id = t.doc_id AND gone.p = t.p GROUP BY t.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM worded LEFT JOIN kept USING (doc_id)"""

#: Scores as stated, of every document that shares a term with the item.
_OP12_SQL = r"""WITH worded AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row_number() OVER () AS d, doc_id, w, len(w) AS n FROM worded WHERE len(w) > 0),
stats AS (SELECT count(*) AS total_docs, CAST(sum(n) AS BIGINT) AS total_terms FROM docs),
tf AS (SELECT d, doc_id, n, t, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(w) AS t FROM docs) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln((2 * total_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, stats GROUP BY t, total_docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
impacts AS (SELECT d, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * total_docs) // total_terms))) AS impact FROM tf JOIN df USING (t), stats),
scored AS (SELECT item_id, d, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (t) GROUP BY item_id, d, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""

#: Strings of 50 bytes by the MD5 of their hex digits; a byte goes if an earlier document starts a string that covers it.
_OP13_SQL = r"""WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
chunks AS (SELECT doc_id, c, n, substr(h, 2 * c + 1, 898) AS p FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 400)) AS c FROM hexed WHERE n >= 50)),
strings AS (SELECT doc_id, c + i AS i, md5_number(substr(p, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, c, p, unnest(range(least(400, n - 49 - c))) AS i FROM chunks)),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s),
starts AS (SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE first < doc_id),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM starts)),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS k FROM runs GROUP BY doc_id, run),
pieces AS (SELECT doc_id, k, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS a, a AS z FROM (SELECT doc_id, k, a, z FROM spans UNION ALL SELECT doc_id, 1000000000, n, n FROM hexed)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY k) AS h FROM pieces JOIN hexed USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256 FROM hexed LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL = {"op8_substring_dedup": _OP8_SQL, "op11_conversation_repair": op11_sql(), "op12_threshold_search": _OP12_SQL, "op13_suffix_dedup": _OP13_SQL}
