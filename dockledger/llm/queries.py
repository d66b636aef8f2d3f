"""The operators over the driver's tables, one named query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dockledger.llm import (
    chat, decontaminate, infill, lines, lm, packing, phrases, pii, quality, rules, sharding, simhash, suffixes,
)
from dockledger.plans.registry import Build, table

QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(build: Build) -> Build:
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build

    return add


# CRC-32 byte by byte, from the table that its polynomial gives.
_CRC_SQL = r"""crc as (
    select list(c order by n) as t from (
        select n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
            lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from range(256) as r(n))
), bytes as (
    select doc_id, text, list_transform(
        list_filter(string_split(
            regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1,', 'g'), ','), lambda p: p <> ''),
        lambda p: ('0x' || p)::bigint) as b
    from documents
)"""


@query(f"""
with {_CRC_SQL}, sized as (
    select doc_id, strlen(coalesce(text, ''))::bigint + 8 as size,
        xor(list_reduce(list_prepend(4294967295::bigint, b),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::bigint as text_crc32
    from bytes, crc
), placed as (
    select *, coalesce(sum(size) over (order by doc_id, text_crc32, size
            rows between unbounded preceding and 1 preceding), 0) as start, sum(size) over () as total
    from sized
), cut as (
    select *, least((2 * start + size) * 24 // (2 * total), 23)::int as shard from placed
)
select doc_id, size, text_crc32, 'bytes' as law, shard,
    row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot,
    null::int as grown_shard
from cut
""")
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), shards=24)


@query()
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer, cached_words=750_000)


@query()
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(r"""
with split as (
    select doc_id, coalesce(text, '') as t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)),
                    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
    from documents
), windows as (
    select doc_id, i, array_to_string(w[i:i + 7], ' ') as k
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) as i from split)
), twice as (
    select doc_id, i from windows
    qualify count(*) over (partition by doc_id, k) > 1
), repeats as (
    select doc_id, count(distinct i + o) as n from twice, range(8) as r(o) group by doc_id
), counts as (
    select doc_id, len(w)::bigint as n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        len(l)::bigint as n_lines,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(n, 0)::bigint as n_repeat_words
    from split left join repeats using (doc_id)
), judged as (
    select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or 10 * n_symbols > n_words or 100 * n_dup_lines > 30 * n_lines
         or word_chars < 2 * n_words or word_chars > 15 * n_words) as kept
from judged
""")
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(table(spark, folder, "documents"))


@query(r"""
with t as (
    select doc_id, coalesce(text, '') as t, row_number() over () as r from documents
), kinds(kind, n, p) as (values
    ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
    ('ip', 1, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
    ('card', 2, '[0-9](?:[\x20-]?[0-9])+'),
    ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]'),
    ('iban', 4, '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b'),
    ('ssn', 5, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b'),
    ('secret', 6, '\b[0-9A-Fa-f]{32,64}\b')
), found as (
    select r, kind, n, regexp_extract_all(t, p) as m, string_split_regex(t, p) as s from t, kinds
), each as (
    select r, kind, n, s, unnest(m) as m, unnest(range(1, len(m) + 1)) as i, m as ms from found where len(m) > 0
), placed as (
    select r, kind, n, m, regexp_replace(m, '[^0-9]', '', 'g') as d,
        list_sum(list_transform(s[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as start,
        right(s[i], 40) as before, left(s[i + 1], 20) as after
    from each
), sums as (
    select *, list_sum(list_transform(range(0, length(d)), lambda i:
            case when i % 2 = 0 then substr(reverse(d), i + 1, 1)::int
                 else (2 * substr(reverse(d), i + 1, 1)::int) % 10
                      + (2 * substr(reverse(d), i + 1, 1)::int) // 10 end)) as luhn
    from placed
), kept as (
    select r, kind, n, start::bigint as a, (start + length(m))::bigint as b from sums
    where case kind
        when 'email' then true
        when 'ip' then len(list_filter(string_split(m, '.'), lambda x: try_cast(x as hugeint) <= 255)) = 4
        when 'card' then length(d) between 14 and 19 and luhn % 10 = 0
        when 'phone' then length(d) between 10 and 15
        when 'ssn' then not regexp_matches(m, '^(000|666|9)|-00-|-0000$')
            and (regexp_matches(before, '(?i)\bssn\b|social security')
                 or regexp_matches(after, '(?i)\bssn\b|social security'))
        when 'secret' then regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Fa-f]')
            and (regexp_matches(before, '(?i)token|secret|passw|api.?key')
                 or regexp_matches(after, '(?i)token|secret|passw|api.?key'))
        else false end
), joined as (
    select r, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip,
        count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
        string_agg(kind || ':' || a || ':' || b, ',' order by a, n) filter (n < 4) as base,
        string_agg(kind || ':' || a || ':' || b, ',' order by a, n) as spans
    from kept group by r
)
select doc_id, coalesce(n_email, 0)::bigint as n_email, coalesce(n_ip, 0)::bigint as n_ip,
    coalesce(n_card, 0)::bigint as n_card, coalesce(n_phone, 0)::bigint as n_phone,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join joined using (r)
""")
def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


@query(r"""
with split as (
    select doc_id, coalesce(text, '') as t, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
    from documents
), keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from split
), owned as (
    select *, length(k) >= 10 and doc_id > min(doc_id) over (partition by k) as gone from keyed
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from owned group by doc_id
""")
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(table(spark, folder, "documents"))


@query()
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_documents(table(spark, folder, "documents"), shingle=3, radius=2)


@query("""
with raw as (
    select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents
), windows as (
    select doc_id, i, b[i:i + 99] as w from (
        select doc_id, b, unnest(range(1, greatest(n - 98, 1))) as i from raw)
), later as (
    select doc_id, i from windows qualify row_number() over (partition by w order by doc_id, i) > 1
), spans as (
    select doc_id, min(i) as a, max(i) + 100 as z from (
        select doc_id, i, sum(new) over (partition by doc_id order by i) as span from (
            select doc_id, i, (i > coalesce(lag(i) over (partition by doc_id order by i), -200) + 100)::int as new
            from later))
    group by doc_id, span
), kept as (
    select doc_id, string_agg(h, '' order by first) as h from (
        select s.doc_id, first, hex(b[first:last - 1]) as h from (
            select doc_id, coalesce(lag(z) over w, 1) as first, a as last from spans
            window w as (partition by doc_id order by a)) s
        join raw using (doc_id)
        union all
        select t.doc_id, t.first, hex(b[t.first:n]) from (
            select doc_id, max(z) as first from spans group by doc_id) t
        join raw using (doc_id))
    group by doc_id
), removed as (
    select doc_id, sum(z - a)::bigint as n_removed, count(*) as n_spans from spans group by doc_id
)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
    sha256(coalesce(unhex(h), b)) as kept_sha256
from raw left join removed using (doc_id) left join kept using (doc_id)
""")
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeat_report(table(spark, folder, "documents"), length=100)


@query()
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.lm_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(r"""
with recursive raw as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all
    select -1, t, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) as v(t, r)
), turns as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
        4 + len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]')) as cost,
        length('<s></s>') + length(role) + 1 + length(regexp_replace(text,
            '(<)(\\*(?:/?s>|/?<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>))|(\[)(\\*(?:/?INST\]))',
            '\1\3\\\2\4', 'g')) as chars
    from raw
), marked as (
    select *, i = 1 and role = 'system' as head from turns
), summed as (
    select *, coalesce(sum(case when head then 0 else cost end) over (partition by conv_id order by i
            rows between unbounded preceding and 1 preceding), 0) as since,
        case when head then 0 else cost end as own,
        max(case when head then cost else 0 end) over (partition by conv_id) as system
    from marked
), past as (
    select *, since - coalesce(min(case when head then null else since end) over (partition by conv_id order by since
            range between 256 preceding and 1 preceding), since) as past
    from summed
), nexts as (
    select a.conv_id, a.i, a.since - a.past as reach, coalesce(min(b.i), 1000000000) as stop
    from past a left join past b on b.conv_id = a.conv_id and b.i > a.i
        and ((b.i - 1) % 256 = 0 or b.since + b.own > a.since + 1024 - a.system - a.past)
    group by a.conv_id, a.i, a.since, a.past
), windows as (
    select * from nexts where i = 1
    union all
    select n.* from windows w join nexts n on n.conv_id = w.conv_id and n.i = w.stop
), formatted as (
    select w.conv_id, sum(t.chars)::bigint as formatted_chars
    from windows w join past t on t.conv_id = w.conv_id and t.i < w.stop
        and (t.head or t.i >= w.i or t.since >= w.reach)
    group by 1
), digests as (
    select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256
    from turns group by 1
)
select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars
from digests join formatted using (conv_id)
""")
def op11_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    return chat.format_report(turns.unionByName(added), budget=1024, history=256)


@query(r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) as p
    from documents
), words as (
    select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces
), grams as (
    select lang, s, array_to_string(w[i:i + s - 1], ' ') as phrase
    from (select lang, w, s, unnest(range(1, len(w) - s + 2)) as i from words, range(1, 6) as r(s) where len(w) >= s)
), counted as (
    select lang, s, phrase, count(*) as a from grams group by all having count(*) >= 100
), totals as (
    select lang, sum(len(w))::bigint as n from words group by 1
), cuts as (
    select c.lang, c.s, c.phrase, c.a, k, x.a as l, y.a as r, n,
        ((1000::hugeint * c.a * n) // (x.a::hugeint * y.a))::bigint as score
    from (select *, string_split(phrase, ' ') as w, unnest(range(1, s)) as k from counted where s > 1) c
    join counted x on x.lang = c.lang and x.phrase = array_to_string(w[1:k], ' ')
    join counted y on y.lang = c.lang and y.phrase = array_to_string(w[k + 1:], ' ')
    join totals t on t.lang = c.lang
), best as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), kept as (
    select * from best b where not exists (
        select 1 from counted c where c.lang = b.lang and c.s > b.s and c.a >= b.a
            and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
)
select lang, rank, phrase, a, l, r, n, score from (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
where rank <= 2000
""")
def op12_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"), longest=5, least=100, top=2000)


@query(r"""
with drawn as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u,
        sha256('7:' || coalesce(doc_id::varchar, '')) as d
    from documents
), numbers as (
    select doc_id, t, u, len(u)::bigint as n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(d, i, 8))::bigint) as h
    from drawn
), cut as (
    select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 100
            then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end as form
    from numbers
), parted as (
    select *, coalesce(array_to_string(u[1:a], ''), '') as p, coalesce(array_to_string(u[a + 1:b], ''), '') as m,
        coalesce(array_to_string(u[b + 1:], ''), '') as s
    from cut
)
select doc_id, n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars,
    case when form <> 'plain' then length(m) end::bigint as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(t) as restored_sha256
from parted
""")
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill.infill_report(table(spark, folder, "documents"))
