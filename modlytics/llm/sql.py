"""The queries in SQL for another engine."""

from __future__ import annotations

from modlytics.llm import licenses, mixing

EXACT = r"""
with signed as (
    select doc_id, length(coalesce(text, '')) as chars,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
    from documents
)
select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by text_sha256) as group_size,
    row_number() over best = 1 as kept, text_sha256
from signed
window best as (partition by text_sha256 order by chars desc, doc_id nulls last)
"""

MIXING = rf"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
        md5('{mixing.SEED}:' || cast(doc_id as varchar)) as key
    from documents
), named as (
    select source, cast(sum(size) as bigint) as source_size,
        list_extract([{", ".join(f"{w}::double" for w in mixing.WEIGHTS)}],
            (row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1) as weight
    from sized group by source
), ends as (
    select *, source_size * {mixing.MOST_REPEATS}::double as most, source_size * {mixing.MOST_REPEATS}::double / weight as "end"
    from named
), levels as (
    select *, (sum(source_size) over () * {mixing.BUDGET}::double - (sum(most) over (order by "end", source nulls last) - most))
        / sum(weight) over (order by "end", source nulls last rows between current row and unbounded following) as level
    from ends
), filled as (
    select min_by(level, "end") as level from levels where level <= "end"
), targets as (
    select source, source_size, least(most, filled.level * weight) as target from levels, filled
), budgets as (
    select *, case when source_size > 0 then floor(floor(target) / source_size) else 0 end as repeats from targets
), ended as (
    select s.doc_id, s.size, b.source_size, b.target, b.repeats, floor(b.target) - b.repeats * b.source_size as rest,
        sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size) as "end"
    from sized s join budgets b on s.source is not distinct from b.source
)
select doc_id, size, source_size, target,
    cast(repeats * size + least(size, greatest(0, rest - ("end" - size))) as bigint) as taken
from ended
"""



def _licenses() -> str:
    strings = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    rows = ", ".join(
        f"('{t.label}', {t.base}, {t.key_at}, {strings(t.words)}, {strings(t.phrase)})" for t in licenses.TEMPLATES
    )
    return rf"""
with templates(label, base, key_at, words, phrase) as (values {rows}),
worded as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.WORD}') as words
    from documents
), standing as (
    select doc_id, d.words as held, t.*, unnest(list_filter(range(len(d.words)),
        lambda i: d.words[i + 1 : i + len(t.phrase)] = t.phrase)) as spot
    from worded d, templates t where list_has_all(d.words, t.phrase)
), places as (
    select doc_id, label, base, spot, len(list_filter(range(len(words)),
        lambda k: spot - key_at + k >= 0 and coalesce(held[spot - key_at + k + 1] = words[k + 1], false))) / len(words) as score
    from standing
), found as (
    select doc_id, count(*) filter (base) as n_base, min(spot) filter (base) as first_word, max(spot) filter (base) as last_word,
        string_agg(distinct label, ',' order by label) filter (base) as base_labels,
        string_agg(distinct label, ',' order by label) as labels, max(score) as score
    from places group by doc_id
)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
    coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score
from worded left join found using (doc_id)
"""


# The other engine has no base 32, so the digest's five-bit groups are looked up one by one.
WARC = r"""
with sized as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hexed from pages
), digested as (
    select page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || hexed[1 + i // 4 * 5 : i // 4 * 5 + 5])::int >> (15 - i % 4 * 5)) & 31)]),
        'string_agg', '') as payload_digest
    from sized
)
select page_id, payload_bytes, payload_digest,
    case when page_id = max(page_id) over same then 'response' else 'revisit' end as record_type,
    case when page_id <> max(page_id) over same then max(page_id) over same end as refers_to
from digested window same as (partition by payload_digest)
"""

NEGATIVES = """
with clean as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where label is not null and embedding is not null and vec_id is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
        cast(list_inner_product(a.v, b.v) as bigint) as score
    from clean a join clean b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
    select anchor_id, other as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
)
select anchor_id, positive_id, row_number() over best as rank, other as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window best as (partition by anchor_id, positive_id order by score desc, other)
qualify row_number() over best <= 5
"""

AUDIT = r"""
with worded as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as held,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
    from documents
), marks as (
    select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id
), failed as (
    select part, good, toxic, {
        'A': len(words) < 200,
        'B': 100 * len(list_distinct(words)) < 50 * len(words),
        'C': 100 * len(regexp_extract_all(held, '[A-Z]')) > 3 * length(held),
        'D': regexp_matches(held, '[#$%&*|]'),
        'E': coalesce(min(doc_id) over (partition by held) < doc_id, false)} as f
    from worded left join marks using (doc_id)
), one as (
    select part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [f.A, f.B, f.C, f.D, f.E]) as f from failed
), grouped as (
    select part, f, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from one group by all
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as l
), orders as (
    select a.l || b.l || c.l || d.l || e.l as filter_order
    from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps as (
    select filter_order, step, substr(filter_order, step, 1) as here, string_split(substr(filter_order, 1, step - 1), '') as earlier,
        list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: x <> substr(filter_order, step, 1)) as others
    from orders, (select unnest([1, 2, 3, 4, 5])::int as step)
), walked as (
    select part, filter_order, step, here, n, good, toxic, f[here] as fails,
        len(list_filter(earlier, lambda x: coalesce(f[x], false))) > 0 as gone,
        len(list_filter(others, lambda x: f[x])) = 0 as alone
    from grouped, steps
), counted as (
    select part, filter_order, step, here,
        cast(coalesce(sum(n) filter (not fails and not gone), 0) as bigint) as kept,
        cast(coalesce(sum(n) filter (fails and not gone), 0) as bigint) as removed,
        cast(coalesce(sum(n) filter (fails and gone), 0) as bigint) as redundant,
        cast(coalesce(sum(n) filter (fails and alone), 0) as bigint) as unique_fails,
        cast(coalesce(sum(good) filter (fails and not gone), 0) as bigint) as good_lost,
        cast(coalesce(sum(toxic) filter (fails and not gone), 0) as bigint) as toxic_lost
    from walked group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    cast(sum(removed) over (partition by part, here) as bigint) as shapley
from counted
"""

ORACLE: dict[str, str] = {"op2_licenses": _licenses(), "op4_exact_dedup": EXACT, "op5_mixing": MIXING, "op7_warc": WARC, "op11_hard_negatives": NEGATIVES, "op12_filter_audit": AUDIT}
