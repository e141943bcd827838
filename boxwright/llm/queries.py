"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm.chat import Template, format_chats, learned_text, read_turns
from boxwright.llm.common import table
from boxwright.llm.divergence import COMMON_WORDS, MARKS, Limits, judge
from boxwright.llm.mix import mix
from boxwright.llm.order_minhash import near_duplicates
from boxwright.llm.phrase_index import SLOP, WINDOW, build_index, digest, search
from boxwright.llm.prefix_trie import grafted, trie, turn_lists
from boxwright.llm.repair import damaged, repaired
from boxwright.llm.shards import plan_shards
from boxwright.llm.simhash import near_duplicates as simhash_components
from boxwright.llm.token_pack import packed_documents
from boxwright.llm.toxicity import score
from boxwright.llm.warc import archived_pages
from boxwright.llm.weak_quality import LEAST_SCORE, scored

#: A conversation whose texts hold control strings of the template.
ODD_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "score", (F.col("score") >= LEAST_SCORE).alias("kept"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"))
    return digest(search(index, table(spark, sf_dir, "benchmark"), SLOP))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "row.doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "copies",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = chats.unionByName(spark.createDataFrame(ODD_CHAT, "conv_id long, turn long, role string, text string"))
    template = Template()
    out = format_chats(chats, template)
    out = out.withColumn("_turns", read_turns(F.col("formatted"), template))
    out = out.withColumn("_learned", learned_text(F.col("segments"), template))
    said = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "end_state",
    )


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_shards(table(spark, sf_dir, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(grafted(turn_lists(table(spark, sf_dir, "conversations"))))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_pack": op3_pack,
    "op4_mix": op4_mix,
    "op5_warc": op5_warc,
    "op6_chat": op6_chat,
    "op7_shards": op7_shards,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_repair": op12_repair,
    "op13_simhash": op13_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op6_chat": """
with recursive chats as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns as (
  select *, length(text) + length(text) - length(translate(text, '[<', '')) + case role
    when 'system' then 11 when 'user' then 13 when 'assistant' then 4
    else 20 + length(role) + length(role) - length(translate(role, '[<', '')) end as n
  from chats
), orders as (
  select conv_id, list(role order by turn nulls first, role, text) as roles from chats group by conv_id
), walk as (
  select conv_id, roles, 0 as k, '' as state from orders
  union all
  select conv_id, roles, k + 1, case
    when state || '>' || roles[k + 1] in ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')
    then roles[k + 1] else '!' end
  from walk where k < len(roles)
), ends as (select conv_id as _id, state as end_state from walk where k = len(roles))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars, first(end_state) = 'assistant' as valid, first(end_state) as end_state
from turns join ends on conv_id is not distinct from _id group by conv_id
""",
    # a digest's 40 hex digits are 160 bits, which are 32 digits of 5 bits
    "op5_warc": """
with rows as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), hashed as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as h from rows
), bits as (
  select *, min(page_id) over (partition by h) as least,
    array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000',
      '1001', '1010', '1011', '1100', '1101', '1110', '1111'][cast(instr('0123456789abcdef', h[i]) as int)]), '') as b
  from hashed
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * cast(b[5 * i + 1] as int)
    + 8 * cast(b[5 * i + 2] as int) + 4 * cast(b[5 * i + 3] as int) + 2 * cast(b[5 * i + 4] as int)
    + cast(b[5 * i + 5] as int)]), '') as payload_digest,
  case when least is null or page_id is null or page_id = least then 'response' else 'revisit' end as record_type,
  case when page_id <> least then least end as refers_to, cast(null as varchar) as error
from bits
""",
    # crc32 by the usual table of 16 entries, over the low and the high half of each digit's byte
    "op11_prefix_trie": """
with recursive turns as (
  select conv_id, turn, md5(cast(length(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) as id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
  from conversations where conv_id is not null
), lists as (
  select conv_id, list({'id': id, 'words': words} order by turn nulls first, id) as turns from turns group by conv_id
), hashed as (
  select *, conv_id - conv_id % 20 as base, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda c: [cast(ascii(c) & 15 as bigint), cast(ascii(c) >> 4 as bigint)])),
    lambda a, x: xor(a >> 4, list_extract([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960,
      1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108],
      cast((xor(a, x) & 15) + 1 as int))), cast(4294967295 as bigint))) % 4 as h
  from lists
), built as (
  select a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) as turns
  from hashed a left join lists b on a.base = b.conv_id
), members as (
  select conv_id, d, len(turns) as n, array_to_string(list_transform(turns[1:d], lambda t: t.id), '') as path,
    case when d = 0 then 0 else turns[d].words end as words
  from (select *, unnest(range(0, len(turns) + 1)) as d from built)
), nodes as (
  select path, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where d = n), '')) as ends_sha256
  from members group by path
), families as (
  select p.path, count(c.path) as n_children from nodes p
  left join nodes c on c.depth = p.depth + 1 and starts_with(c.path, p.path) group by p.path
), sums as (
  select p.path, count(*) filter (where f.n_children = 0) as n_leaves, sum((c.n_convs - 1) * c.words) as saved_tokens
  from nodes p join nodes c on starts_with(c.path, p.path) join families f on f.path = c.path group by p.path
)
select n.conv_id, cast(n.depth as bigint) as depth, u.conv_id as parent_conv_id, n.n_convs, f.n_children, s.n_leaves,
  cast(s.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n join families f using (path) join sums s using (path)
left join nodes u on n.depth > 0 and u.path = left(n.path, 32 * (n.depth - 1))
""",
    # the cheapest way into each state of `(s?(ua)+)?` as (cost, audit, text), turn by turn; runs of inserts before a turn are
    # ways between states
    "op12_repair": """
with recursive hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''),
      lambda c: [cast(ascii(c) & 15 as bigint), cast(ascii(c) >> 4 as bigint)])),
    lambda a, x: xor(a >> 4, list_extract([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960,
      1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108],
      cast((xor(a, x) & 15) + 1 as int))), cast(4294967295 as bigint))) % 20 as f
  from conversations
), turns as (
  select conv_id, turn, case f when 4 then 'user' else role end as role,
    case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, unnest(range(0, case f when 0 then 0 when 3 then 2 else 1 end)) where f <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as rest from turns
), kinds as (
  select *, case when rest = '' then 'b' when row_number() over (partition by conv_id, role, text order by k) > 1 then 'd'
    when right(rest, 1) in ('.', '!', '?') then '' else 't' end as kind,
    left(role, 1) as i, left(lag(role) over (partition by conv_id order by k), 1) as before
  from placed
), counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (where kind = 'b') as blank, count(*) filter (where kind = 'd') as duplicate,
    count(*) filter (where kind = 't') as truncated,
    count(*) filter (where before is not null and before || i not in ('su', 'ua', 'au')) as illegal
  from kinds group by conv_id
), inserts(p, q, run, said) as (
  values ('0', '0', '', []), ('S', 'S', '', []), ('U', 'U', '', []), ('A', 'A', '', []), ('0', 'U', 'I', ['user:']),
    ('S', 'U', 'I', ['user:']), ('A', 'U', 'I', ['user:']), ('U', 'A', 'I', ['assistant:']),
    ('0', 'A', 'II', ['user:', 'assistant:']), ('S', 'A', 'II', ['user:', 'assistant:'])
), walk as (
  select conv_id, 0 as k, '0' as state, 0 as cost, '' as audit, cast([] as varchar[]) as said from counts
  union all
  select conv_id, k, state, best.cost, best.audit, best.said from (
    select w.conv_id, t.k, e.state, min({'cost': w.cost + 2 * length(n.run) + e.cost, 'audit': w.audit || n.run || e.edit,
      'said': list_concat(w.said, n.said, case when e.role is null then [] else [e.role || ':' || t.text] end)}) as best
    from walk w join kinds t on t.conv_id is not distinct from w.conv_id and t.k = w.k + 1 join inserts n on n.p = w.state,
    lateral (
      select 'D' as edit, n.q as state, 3 as cost, cast(null as varchar) as role
      union all select 'R', case n.q when 'U' then 'A' else 'U' end, 2 + (t.kind = 't')::int,
        case n.q when 'U' then 'assistant' else 'user' end where t.kind not in ('b', 'd')
      union all select 'K', upper(t.i), (t.kind = 't')::int, t.role
        where t.kind not in ('b', 'd') and n.q || t.i in ('0s', '0u', 'Su', 'Ua', 'Au')
    ) e group by w.conv_id, t.k, e.state
  )
), ends as (
  select w.conv_id, min({'cost': w.cost + 2 * length(n.run), 'audit': w.audit || n.run, 'said': list_concat(w.said, n.said)}) as best
  from walk w join counts c on c.conv_id is not distinct from w.conv_id and w.k = c.n join inserts n on n.p = w.state and n.q in ('0', 'A')
  group by w.conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost,
  coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id
left join ends e on e.conv_id is not distinct from o.conv_id
""",
}


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ITEM_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Exact windows meet the texts' windows of their length; for proximity, stretches of the texts that have all words of a window are cut
#: where the last of them first occurs.
ORACLE_SQL["op2_decontaminate"] = f"""
with d as (
  select row_number() over () as rid, doc_id, {_ITEM_WORDS} as w from documents
), i as (
  select coalesce(cast(item_id as varchar), '') as item, {_ITEM_WORDS} as w from benchmark
), cut as (
  select item, unnest(case when len(w) < {WINDOW} then [w]
    else list_transform(range(1, len(w) - {WINDOW - 2}), lambda k: w[k:k + {WINDOW - 1}]) end) as x from i where len(w) > 0
), win as (
  select array_to_string(x, ' ') as t, first(x) as x, list_distinct(first(x)) as words, len(first(x)) as n, list(distinct item) as items
  from cut group by t
), runs as (
  select rid, n, list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' ')) as ts
  from d, (select distinct n from win) where len(w) >= n
), places as (
  select rid, n, unnest(ts) as t, generate_subscripts(ts, 1) as a from runs
), exact as (
  select rid, a, n as length, items from places join win using (n, t)
), has as (
  select rid, t from (select distinct rid, unnest(w) as word from d)
  join (select t, len(words) as least, unnest(words) as word from win) using (word) group by rid, t, least having count(*) = least
), starts as (
  select rid, w, words, n, items, unnest(list_filter(range(1, len(w) + 1),
    lambda a: list_contains(words, w[a]) and list_has_all(w[a:a + n + {SLOP - 1}], words))) as a
  from has join d using (rid) join win using (t)
), near as (
  select rid, a, items, list_max(list_transform(words, lambda x: list_position(w[a:a + n + {SLOP - 1}], x))) as length from starts
), sums as (
  select rid, kind, count(distinct place) as n from (
    select rid, 0 as kind, unnest(range(a, a + length)) as place from exact
    union all select rid, 1, unnest(range(a, a + length)) from near
  ) group by rid, kind
), ids as (
  select rid, kind, list(distinct item order by item) as items from (
    select rid, 0 as kind, unnest(items) as item from exact union all select rid, 1, unnest(items) from near
  ) group by rid, kind
)
select doc_id, len(w) as n_words, coalesce(s0.n, 0) as n_hit, coalesce(len(i0.items), 0) as n_items,
  sha256(coalesce(array_to_string(i0.items, ','), '')) as items_sha256, coalesce(s0.n, 0) > 0 as contaminated,
  coalesce(s1.n, 0) as n_near, coalesce(len(i1.items), 0) as n_near_items
from d left join sums s0 on s0.rid = d.rid and s0.kind = 0 left join sums s1 on s1.rid = d.rid and s1.kind = 1
left join ids i0 on i0.rid = d.rid and i0.kind = 0 left join ids i1 on i1.rid = d.rid and i1.kind = 1
"""


def _divergence_sql() -> str:
    """The rules with their usual limits; histograms are lists, references their sums by language."""
    lim, quoted = Limits(), lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    lists = " ".join(f"when '{k}' then {quoted(ws)}" for k, ws in COMMON_WORDS.items())
    marks = MARKS.replace("'", "''")
    most = max(map(len, COMMON_WORDS.values())) + 1
    count = lambda pattern: f"length(regexp_replace(text, '[^{pattern}]', '', 'g'))"
    classes = [r"\p{Ll}", r"\x20\x09-\x0D", r"\p{Lu}", r"\p{N}", ".,;:!?''\"()\\-", "#*$%&|<>", "=+_/\\\\^~`@\\[\\]{}"]
    refs = ", ".join(f"[{', '.join(f'sum(coalesce({name}[{k + 1}], 0))' for k in range(n))}] as ref_{name}" for name, n in (("classes", 8), ("common", most)))

    def far(name: str, out: str, ok: str) -> str:
        a, b = f"list_sum({name})", f"list_sum(ref_{name})"
        p, q = f"(coalesce(z[1], 0) / {a}::double)", f"(coalesce(z[2], 0) / {b}::double)"
        half = lambda x: f"case when {x} > 0 then {x} * log2({x} / (({p} + {q}) / 2)) else 0 end"
        terms = f"list_transform(list_zip({name}, ref_{name}), lambda z: {half(p)} + {half(q)})"
        return f"case when {ok} and {a} > 0 and {b} > 0 then sqrt(greatest(0, list_sum({terms}) / 2)) end as {out}"

    measured = f"""select c.*, {far("classes", "cd", f"chars >= {lim.class_least_chars}")},
  {far("common", "wd", f"n_words >= {lim.word_least_words} and lang <> ''")} from counts c left join"""
    passed = f"coalesce(cd, 0) <= {lim.class_distance} and coalesce(wd, 0) <= {lim.word_distance}"
    return f"""
with texts as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, case when lang in ({quoted(COMMON_WORDS)[1:-1]}) then lang else '' end as lang
  from documents
), words as (
  select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(text, chr(10)),
    lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines, coalesce(case lang {lists} end, []) as known from texts
), five as (
  select rid, list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) as ts from words where len(w) >= 5
), runs as (
  select rid, unnest(ts) as t, generate_subscripts(ts, 1) as a from five
), twice as (
  select rid, unnest(range(a, a + 5)) as place from (select rid, a, count(*) over (partition by rid, t) as n from runs) where n > 1
), again as (
  select rid, count(distinct place) as n from twice group by rid
), counted as (
  select rid, doc_id, lang, len(w) as n_words, {count(classes[5])} as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    length(text) as chars, [{", ".join(map(count, classes))}] as cs, known,
    list_transform(w, lambda x: lower(trim(x, '{marks}'))) as plain from words
), found as (
  select *, list_transform(known, lambda x: len(list_filter(plain, lambda y: y = x))) as ws from counted
), counts as (
  select f.* exclude (plain, known), chars - cs[2] as word_chars, coalesce(n, 0) as n_repeat_words,
    list_append(cs, chars - list_sum(cs)) as classes, list_append(ws, n_words - coalesce(list_sum(ws), 0)) as common,
    n_words < {lim.least_words} or 100 * coalesce(n, 0) > {lim.repeat_percent} * n_words as base_failed
  from found f left join again using (rid)
), once as (
  {measured} (select lang, {refs} from counts where not base_failed group by lang) r using (lang)
), last as (
  {measured} (select lang, {refs} from once where not base_failed and {passed} group by lang) r using (lang)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 9) as class_distance,
  round(wd, 9) as word_distance, not base_failed and {passed} as kept from last
"""


ORACLE_SQL["op9_quality_rules"] = _divergence_sql()
