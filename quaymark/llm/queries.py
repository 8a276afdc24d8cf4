"""Thin queries of the training-data operators over the driver tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm import chat_windows, decontamination, dialogue_repair, jpeg_media, line_rules, maglev, merkle, mixing, ngram_join, packing, suffix_lm, toxicity, warc_store
from quaymark.llm.common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.assess(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.assess(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return maglev.place(docs, "doc_id", maglev.shard_names()).select("doc_id", "source", "slot", "shard", "shard_name")


#: What conversation -1 says in both of its turns: the marks of a common chat template.
OP7_MARKS = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.sql(f"select -1L as conv_id, turn, role, '{OP7_MARKS}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return chat_windows.digest(chat_windows.windows(rows.unionByName(marks)))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.describe(warc_store.archive(table(spark, sf_dir, "pages")))


def op10_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return dialogue_repair.repair(dialogue_repair.damage(rows), rows)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.verify(merkle.build(merkle.document_leaves(table(spark, sf_dir, "documents"))))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_toxicity, op3_mixing, op4_suffix_lm, op5_ngram_join, op6_sharding, op7_chat, op8_packing, op9_warc, op10_quality_lines, op11_dialogue_repair, op12_merkle, op13_decontamination)}


#: The table filled by turns, as a recursive query: the state is the owner of each slot and where each shard's walk stands.
OP6_SQL = f"""
with recursive names as (
  select k, 'shard-' || lpad(cast(k as varchar), 4, '0') as name from range({maglev.SHARDS}) t(k)
), walks as (
  select list(cast('0x' || substr(md5(name || '/offset'), 1, 15) as bigint) % {maglev.SLOTS} order by k) as offs,
         list(cast('0x' || substr(md5(name || '/skip'), 1, 15) as bigint) % {maglev.SLOTS - 1} + 1 order by k) as steps
  from names
), fill(turn, owner, pos, steps) as (
  select 0, list_transform(range({maglev.SLOTS}), lambda x: -1), offs, steps from walks
  union all
  select turn + 1, list_transform(owner, lambda x, i: case when i = free + 1 then s else x end),
         list_transform(pos, lambda x, i: case when i = s + 1 then (free + steps[i]) % {maglev.SLOTS} else x end), steps
  from (
    select *, list_filter(list_transform(range({maglev.SLOTS}), lambda j: (pos[s + 1] + j * steps[s + 1]) % {maglev.SLOTS}), lambda x: owner[x + 1] < 0)[1] as free
    from (select *, turn % {maglev.SHARDS} as s from fill where turn < {maglev.SLOTS})
  )
), full_table as (
  select generate_subscripts(owner, 1) - 1 as slot, unnest(owner) as shard from fill where turn = {maglev.SLOTS}
), keyed as (
  select doc_id, source, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '\\N')), 1, 15) as bigint) % {maglev.SLOTS} as slot from documents
)
select doc_id, source, cast(slot as bigint) as slot, cast(shard as int) as shard, name as shard_name
from keyed join full_table using (slot) join names on k = shard
"""

#: formatted_chars needs the template and the window rule, the rest only the rows.
OP7_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{OP7_MARKS}' union all select -1, 1, 'assistant', '{OP7_MARKS}'
), t as (
  select *, row_number() over (partition by conv_id order by turn, role, text) - 1 as i,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {chat_windows.MARK_TOKENS} as tokens,
    8 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\\\<>\\[]', '', 'g')) as size from c
), p as (
  select *, sum(tokens) over w as e, max(case when i = 0 and role = 'system' then tokens else 0 end) over (partition by conv_id) as fixed
  from t window w as (partition by conv_id order by i rows unbounded preceding)
), g as (
  select *, 512 - fixed as rest, greatest(1, (512 - fixed) // 3) as step, e - tokens as b from p
), k as (
  select *, case when e <= 512 then 0 else 1 + (e - 513) // step end as cell from g
), h as (
  select *, coalesce(lag(cell) over (partition by conv_id order by i) <> cell, true) as head from k
), n as (
  select *, sum(cast(head as int)) over (partition by conv_id) - 1 as more,
    coalesce(lead(head, 1) over w and lead(b, 1) over w - b <= rest - 2 * step, false) as h1,
    coalesce(lead(head, 2) over w and lead(b, 2) over w - b <= rest - 2 * step, false) as h2
  from h window w as (partition by conv_id order by i)
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(size * (1 + case when i = 0 and role = 'system' then more else cast(h1 as int) + cast(h2 as int) end)) as bigint) as formatted_chars
from n group by conv_id
"""

OP9_SQL = """
with p as (
  select page_id, coalesce(html, '') as payload, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages
), r as (
  select *, max(page_id) over (partition by payload) as top from p
)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(
    ((strpos('0123456789abcdef', substr(h, cast(floor(5 * i / 4.0) as int) + 1, 1)) - 1) * 16
     + greatest(strpos('0123456789abcdef', substr(h, cast(floor(5 * i / 4.0) as int) + 2, 1)) - 1, 0)) as int) // [8, 4, 2, 1][i % 4 + 1] % 32 + 1, 1)), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from r
"""


def _crc32(x: str) -> str:
    """The checksum of a string of ASCII characters, bit by bit."""
    return (
        f"xor(list_reduce(list_transform(range(length({x})), lambda k: cast(ascii(substr({x}, k + 1, 1)) as bigint)), lambda c, b: "
        "list_reduce(range(8), lambda d, k: case when d & 1 = 1 then xor(d >> 1, 3988292384) else d >> 1 end, xor(c, b)), 4294967295), 4294967295)"
    )


#: v holds the best repair of what follows, for each state of the grammar: cost, audit, repaired lines.  It is carried from the last turn to the first.
OP11_SQL = f"""
with recursive c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations
), k as (
  select *, {_crc32("name")} % 20 as k from c
), d as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from k, unnest(case when k = 3 then [0, 1] else [0] end) as u(copy) where k <> 0
), s as (
  select *, row_number() over (partition by conv_id, role, text order by turn nulls first) > 1 as seen from d
), t as (
  select conv_id, turn, role, text, row_number() over w as i, count(*) over (partition by conv_id) as n, substr(role, 1, 1) as letter, lag(substr(role, 1, 1)) over w || substr(role, 1, 1) as pair,
    case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when seen then 'duplicate' when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else '' end as fault
  from s window w as (partition by conv_id order by turn nulls first, role, text, seen)
), v(conv_id, i, v) as (
  select conv_id, n + 1, [{{c: 0::bigint, a: '', r: ''}}, {{c: 10::bigint, a: 'II', r: chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{c: 5::bigint, a: 'I', r: chr(10) || 'assistant:'}}, {{c: 0::bigint, a: '', r: ''}}]
  from t where i = n
  union all
  select conv_id, i, [list_sort([f[1], {{c: 5 + u.c, a: 'I' || u.a, r: chr(10) || 'user:' || u.r}}])[1], list_sort([f[2], {{c: 5 + u.c, a: 'I' || u.a, r: chr(10) || 'user:' || u.r}}])[1], u,
    list_sort([f[4], {{c: 5 + f[3].c, a: 'I' || f[3].a, r: chr(10) || 'user:' || f[3].r}}])[1]]
  from (
    select *, list_sort([f[3], {{c: 5 + f[4].c, a: 'I' || f[4].a, r: chr(10) || 'assistant:' || f[4].r}}])[1] as u
    from (
      select t.conv_id, t.i, list_transform(range(4), lambda q: list_sort(list_filter([
          {{c: 2 + v[q + 1].c, a: 'D' || v[q + 1].a, r: v[q + 1].r}},
          case when to_next[q + 1] > 0 and fault not in ('blank', 'duplicate') then {{c: late + v[to_next[q + 1]].c, a: 'K' || v[to_next[q + 1]].a, r: chr(10) || role || ':' || text || v[to_next[q + 1]].r}} end,
          case when fault not in ('blank', 'duplicate') then {{c: 1 + late + v[[3, 3, 4, 3][q + 1]].c, a: 'R' || v[[3, 3, 4, 3][q + 1]].a,
            r: chr(10) || ['user', 'user', 'assistant', 'user'][q + 1] || ':' || text || v[[3, 3, 4, 3][q + 1]].r}} end], lambda x: x is not null))[1]) as f
      from v join (select *, case when fault = 'truncated' then 5 else 0 end as late,
          case letter when 's' then [2, 0, 0, 0] when 'u' then [3, 3, 0, 3] when 'a' then [0, 0, 4, 0] else [0, 0, 0, 0] end as to_next from t) t on t.conv_id is not distinct from v.conv_id and t.i = v.i - 1
    )
  )
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from t group by conv_id
), best as (
  select conv_id, v[1].c as cost, v[1].a as audit, sha256(substr(v[1].r, 2)) as repaired_sha256 from v where i = 1
)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join facts f on f.conv_id is not distinct from o.conv_id left join best b on b.conv_id is not distinct from o.conv_id
"""


def _op12_sql(levels: int = 7, top_levels: int = 3) -> str:
    """Level by level, as often as trees of 8 ** levels leaves and 8 ** top_levels groups need; a tree of one node stays as it is."""
    field = lambda x: f"coalesce(octet_length(encode(cast({x} as varchar))) || ':' || {x}, '-')"
    leaf = lambda t: f"sha256({' || '.join(field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', t))})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"d as (select doc_id, coalesce('=' || lang, '') as g, {leaf('text')} as leaf, case when {_crc32('name')} % 3 = 0 then {leaf('low')} else {leaf('text')} end as altered from (select *, cast(doc_id as varchar) as name, {low} as low from documents))",
        "l as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as k, count(*) over (partition by g) as n from d)",
        "a0 as (select g, k, leaf as h, n from l)",
    ]

    def raise_(name: str, upto: int):
        for j in range(upto):
            parts.append(f"{name}{j + 1} as (select g, k // 8 as k, case when min(n) = 1 then min(h) else sha256(string_agg(h, '' order by k)) end as h, (min(n) + 7) // 8 as n from {name}{j} group by g, k // 8)")
            parts.append(f"{name}s{j} as (select x.g, x.k, x.n, coalesce(string_agg(y.h, '' order by y.k) filter (y.k < x.k), '') as b, coalesce(string_agg(y.h, '' order by y.k) filter (y.k > x.k), '') as e from {name}{j} x left join {name}{j} y on x.g = y.g and x.k // 8 = y.k // 8 and x.k <> y.k group by x.g, x.k, x.n)")

    raise_("a", levels)
    parts.append(f"t0 as (select 'top' as g, row_number() over (order by g) - 1 as k, h, count(*) over () as n, g as grp from a{levels})")
    raise_("t", top_levels)
    parts.append("p0 as (select doc_id, g, k, leaf, altered as h, '' as proof from l)")

    def climb(name: str, first: int, upto: int):
        for j in range(upto):
            parts.append(f"p{first + j + 1} as (select p.* replace (case when s.n = 1 then p.h else sha256(s.b || p.h || s.e) end as h, p.proof || s.b || s.e as proof) from p{first + j} p join {name}s{j} s on s.g = p.g and s.k = p.k // {8**j})")

    climb("a", 0, levels)
    parts.append(f"q as (select p.doc_id, 'top' as g, t.k, p.leaf, p.h, p.proof, t.h as subroot from p{levels} p join t0 t on t.grp = p.g)")
    parts.append(f"p{levels + 1} as (select * from q)")
    climb("t", levels + 1, top_levels)
    return f"with {', '.join(parts)} select p.doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, p.h as folded_root, p.h = r.h as verified from p{levels + 1 + top_levels} p cross join t{top_levels} r"


OP12_SQL = _op12_sql()

OP13_SQL = f"""
with d as (
  select doc_id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), v as (
  select distinct item_id, least({decontamination.SIZE}, len(w)) as n, array_to_string(w[k:k + least({decontamination.SIZE}, len(w)) - 1], ' ') as win
  from b, unnest(range(1, len(w) - least({decontamination.SIZE}, len(w)) + 2)) as u(k) where len(w) > 0
), g as (
  select row, n, k, array_to_string(w[k:k + n - 1], ' ') as win from d, (select distinct n from v) s, unnest(range(1, len(w) - n + 2)) as u(k)
), h as (
  select row, item_id, k, g.n from g join v using (n, win)
), f as (
  select row, count(distinct k + j) as n_hit, count(distinct item_id) as n_items from h, unnest(range(n)) as u(j) group by row
), i as (
  select row, string_agg(id, ',' order by id) as ids from (select distinct row, cast(item_id as varchar) as id from h) group by row
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join f using (row) left join i using (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_sharding": OP6_SQL, "op7_chat": OP7_SQL, "op9_warc": OP9_SQL, "op11_dialogue_repair": OP11_SQL, "op12_merkle": OP12_SQL, "op13_decontamination": OP13_SQL}
