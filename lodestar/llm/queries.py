"""The registered queries of this subpackage: QUERIES by name, ORACLE with SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op4_bpe
from .decontaminate import op5_decontaminate
from .langid import op6_langid
from .licenses import op3_licenses
from .minhash import op11_minhash
from .passages import op10_passages
from .periods import op13_periods
from .sharding import op8_sharding
from .simhash import op2_simhash
from .suffix import op1_suffix_dedup
from .topk import op7_topk
from .toxicity import op9_toxicity
from .whitening import op12_whitening

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op10_passages": op10_passages,
    "op11_minhash": op11_minhash,
    "op12_whitening": op12_whitening,
    "op13_periods": op13_periods,
    "op3_licenses": op3_licenses,
    "op4_bpe": op4_bpe,
    "op5_decontaminate": op5_decontaminate,
    "op6_langid": op6_langid,
    "op7_topk": op7_topk,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
}
ORACLE: dict[str, str] = {
    "op1_suffix_dedup": """WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h, length(coalesce(hex(encode(text)), ''))//2 AS n FROM documents),
      w AS (SELECT doc_id, p, substr(h, 2*p+1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n-49)) AS p FROM d WHERE n >= 50)),
      g AS (SELECT doc_id, p FROM w JOIN (SELECT s, min(doc_id) AS least FROM w GROUP BY 1) USING (s) WHERE doc_id > least),
      r AS (SELECT doc_id, min(p) AS a, max(p)+50 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM g)) GROUP BY doc_id, k),
      l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b-a)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY 1)
      SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(coalesce(list_aggregate(list_transform(range(0, len(a)+1), lambda i: substr(h, 2*(CASE WHEN i=0 THEN 0 ELSE b[i] END)+1, 2*(CASE WHEN i=len(a) THEN n ELSE a[i+1] END)-2*(CASE WHEN i=0 THEN 0 ELSE b[i] END))), 'string_agg', ''), h))) AS kept_sha256
      FROM d LEFT JOIN l USING (doc_id)""",
    "op7_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024*x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0)
      SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id%100=0 AND v.vec_id<>q.vec_id AND len(q.e)=len(v.e))) WHERE rank <= 10""",
}
