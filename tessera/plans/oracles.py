"""DuckDB SQL for the registered queries: shared common table expressions and one select each."""

from __future__ import annotations

from tessera.functions.text import LEGAL_FORMS, LEGAL_SUFFIXES, STREET_WORDS
from tessera.operators.blocking import CAPS, WEIGHTS
from tessera.operators.decision import DIAGONAL, FREE_GRID, MATCH_GRID, POLICY_GRID, SINGLETON_GRID
from tessera.operators.fusion import CHANNEL_DEPTHS, CHANNEL_WEIGHTS

_VALUES = lambda rows: ", ".join(f"({', '.join(repr(x) for x in r)})" for r in rows)

RECORDS = """
rec as (
  select 'S' || (1 + p_partkey % 3) || '-' || p_partkey as id, 'S' || (1 + p_partkey % 3) as source, p_name as name,
    p_size || ' ' || lower(p_type) || ' st' as address, p_brand as country, lower(p_type) as kind from part
),
q as (select id as qid, name, address, country, kind from rec where source = 'S1'),
p as (select id as tid, name, address, country, kind from rec where source <> 'S1'),
truth as (select qid, tid from q join p using (name, kind, country)),
required as (select qid, country from q),
n_true as (select qid, country, coalesce(n, 0) as n_true from required left join (select qid, count(*) as n from truth group by 1) using (qid))
"""


def _keys(source: str, own: str, stop: str = "''", country: str = "country") -> str:
    places = "list_filter(string_split(address, ' '), lambda t: length(t) >= 3)"
    part = lambda kind, expr, where="true": f"select {own}, {country} as country, '{kind}' as key_type, {expr} as key from {source} where {where}"
    return " union all ".join([
        part("exact", "name", "name <> ''"),
        f"select * from ({part('token', "unnest(string_split(name, ' '))")}) where length(key) >= 3 and key not in ({stop})",
        part("prefix", "substr(replace(name, ' ', ''), 1, 4)", "length(replace(name, ' ', '')) >= 4"),
        f"select * from ({part('pin', "unnest(regexp_extract_all(address, '\\d+'))")}) where length(key) between 5 and 6",
        f"select distinct * from ({part('bignum', "unnest(regexp_extract_all(name || ' ' || address, '\\b\\d{4,}\\b'))")})",
        part("house", f"regexp_extract(address, '\\b(\\d{{1,3}})\\b', 1) || '|' || {places}[1]", f"regexp_extract(address, '\\b(\\d{{1,3}})\\b', 1) <> '' and len({places}) > 0"),
        f"select * from ({part('loc', f'unnest({places})')}) where length(key) >= 6",
    ])


CAP_TABLE = f"caps(key_type, cap, weight) as (values {_VALUES([(k, CAPS[k], WEIGHTS[k]) for k in CAPS])})"
KEYS = f"{CAP_TABLE}, pk as ({_keys('p', 'tid')}), qk as ({_keys('q', 'qid')})"


def _structured(name: str, top: int, qk: str = "qk", pk: str = "pk") -> str:
    return f"""
{name} as (
  select * from (
    select qid, tid, score, row_number() over (partition by qid order by score desc, tid) as rank from (
      select qid, tid, round(sum(weight / log2(2 + n)), 6) as score
      from {qk} join {pk} using (country, key_type, key)
      join (select country, key_type, key, count(*) as n from {pk} group by all) using (country, key_type, key)
      join caps using (key_type) where n <= cap group by qid, tid)
  ) where rank <= {top}
)"""


def _lexical(name: str, column: str, top: int | str, where: str = "", prefix: str = "", max_df: float | str = 0.6, min_df: int | str = 2, least: float = 0.0, q: str = "q", p: str = "p") -> str:
    """Grams of three and four characters of blank-padded tokens. ``top`` and the limits may be expressions of the country."""
    grams = lambda own, source: f"""
  select {own}, country, gram, count(*) as tf from (
    select {own}, country, unnest(list_transform(range(1, greatest(length(w) - n + 1, 1) + 1), lambda i: substr(w, i, n))) as gram
    from (select {own}, country, ' ' || unnest(string_split(lower({column}), ' ')) || ' ' as w from {source} {where if own == 'qid' else ''}), (values (3), (4)) as s(n)
    where n = 3 or length(w) > 3) group by all"""  # noqa: E731
    x = prefix or name
    return f"""
{x}_pg as ({grams('tid', p)}), {x}_qg as ({grams('qid', q)}),
{x}_idf as (
  select country, gram, ln((1 + n) / (1 + df)) + 1 as idf
  from (select country, gram, count(*) as df from {x}_pg group by all) join (select country, count(*) as n from {p} group by 1) using (country)
  where df >= {min_df} and df <= ({max_df}) * n),
{x}_pw as (select tid, country, gram, w / sqrt(sum(w * w) over (partition by tid)) as w from (select tid, country, gram, (1 + ln(tf)) * idf as w from {x}_pg join {x}_idf using (country, gram))),
{x}_qw as (select qid, country, gram, w / sqrt(sum(w * w) over (partition by qid)) as w from (select qid, country, gram, (1 + ln(tf)) * idf as w from {x}_qg join {x}_idf using (country, gram))),
{name} as (
  select qid, tid, score, rank from (
    select qid, tid, country, score, row_number() over (partition by qid order by score desc, tid) as rank from (
      select qid, tid, country, round(sum(a.w * b.w), 6) as score from {x}_qw a join {x}_pw b using (country, gram) group by qid, tid, country) where score > {least}
  ) where rank <= {top}
)"""


BASE = f"with {RECORDS}, {KEYS}, {_structured('hits', 20)}"
SCORED = BASE + """,
scored as (
  select qid, tid, (('0x' || substr(md5(qid || '|' || tid), 1, 6))::bigint % 1000) / 1000.0 as p, country, case when t.tid is null then 0 else 1 end as is_match
  from hits join required using (qid) left join (select qid, tid from truth) t using (qid, tid)
)"""
F05 = "case when n_true = 0 then case when n_pred = 0 then 1.0 else 0.0 end when n_pred = 0 then 0.0 else 5.0 * n_tp / (n_true + 4 * n_pred) end"


def _count(pairs: str, name: str = "counts") -> str:
    return f"""
{name} as (
  select qid, country, n_true, coalesce(n_pred, 0) as n_pred, coalesce(n_tp, 0) as n_tp
  from n_true left join (select qid, count(*) as n_pred, count(t.tid) as n_tp from (select distinct qid, tid from {pairs}) x left join (select qid, tid from truth) t using (qid, tid) group by qid) using (qid)
)"""


def _decided(ts: float, tm: float) -> str:
    return f"select qid, tid, p from (select *, max(p) over (partition by qid) as best from scored) where best >= {ts} and p >= {tm}"


DECIDED = f"{SCORED}, decided as ({_decided(0.7, 0.6)}), {_count('decided')}, scores as (select *, {F05} as f05 from counts)"
CANDIDATES = f"{BASE}, {_count('hits')}"
FUSED = f"{BASE}, {_lexical('lex', 'name', 20)}, allhits as (select 'name_only' as channel, * from lex union all select 'structured', * from hits)"


def _rrf(name: str, weight: str, shift: int = 0) -> str:
    return f"""
{name} as (
  select *, row_number() over (partition by qid order by rrf desc, tid) as rrf_rank from (
    select qid, tid, round(sum({weight} / (60 + rank - {shift})), 12) as rrf from allhits group by qid, tid)
)"""


WEIGHT = "case channel when 'name_only' then 0.8::double else 0.7::double end"
RRF = f"{FUSED}, {_rrf('fused', WEIGHT)}"
DUPES = "dupes as (select a.tid, b.tid as sibling from p a join p b using (name, address) where a.tid <> b.tid and trim(name) <> '' and trim(address) <> '')"

_REPORT = """
  count(*) as n_queries, round(avg(case when n_true = 0 then 1.0 when n_tp = 0 then 0.0 else 5.0 * n_tp / (n_true + 4 * n_tp) end), 6) as oracle_f05,
  round(sum(n_tp) / nullif(sum(n_true), 0), 6) as pair_recall, round(avg(n_pred), 6) as mean_k,
  round(avg(case when n_true > 0 then case when n_tp = n_true then 1.0 else 0.0 end end), 6) as all_retrieved,
  round(avg(case when n_true > 0 then case when n_tp = 0 then 1.0 else 0.0 end end), 6) as zero_hit,
  cast(sum(case when n_true = 0 then 1 else 0 end) as bigint) as n_singletons"""


def _sweep(cells: list[tuple[float, float]]) -> str:
    return f"""{SCORED}, cells(ts, tm) as (values {_VALUES(cells)}),
best as (select qid, max(p) as best from scored group by 1),
each as (
  select ts, tm, qid, n_true, coalesce(n_pred, 0) as n_pred, coalesce(n_tp, 0) as n_tp
  from (n_true cross join cells) left join (
    select ts, tm, qid, count(*) as n_pred, sum(is_match) as n_tp from scored join best using (qid), cells where best >= ts and p >= tm group by all
  ) using (ts, tm, qid)
),
swept as (select ts::double as ts, tm::double as tm, round(avg({F05}), 9) as macro_f05 from each group by all)"""


_GRID = [(a, b) for a in SINGLETON_GRID for b in MATCH_GRID]
_CUSTOMERS = "with ids as (select 'S1-' || c_custkey as qid, c_mktsegment, c_custkey % 8 as n_matches from customer)"
_EXPOSED = "('0x' || substr(md5(qid), 1, 2))::int % 10 = 0"
_BUCKET = lambda n: f"case when {n} = 0 then '0-singleton' when {n} = 1 then '1' when {n} <= 3 then '2-3' when {n} <= 5 then '4-5' else '6+' end"
_KEY = lambda seed: f"('0x' || substr(sha256('{seed}|' || qid), 1, 16))::uhugeint"
_SPLIT = f"case when {_EXPOSED} then 'dev-exposed' when {_KEY('f05-v1')} % 100 < 80 then 'train' when {_KEY('f05-v1')} % 100 < 90 then 'dev' else 'holdout' end"


_NUMBER = "cast(string_split(id, '-')[2] as bigint)"
_REAL = lambda own: f"['US', 'India', 'France', 'Peru'][cast(string_split({own}, '-')[2] as bigint) % 4 + 1]"
_OTHERS = lambda tables, t: "coalesce(case country " + " ".join(f"when '{c}' then {_MAP(x)}[{t}]" for c, x in tables.items() if c != "__default__") + f" else {_MAP(tables['__default__'])}[{t}] end, {t})"
_MAP = lambda x: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in x.items()) + "}"
_EXPANDED = lambda x, tables: f"array_to_string(list_transform(string_split({x}, ' '), lambda t: {_OTHERS(tables, 't')}), ' ')"


def _primary(x: str) -> str:
    """The primary view, for texts whose only dotted initials are these."""
    y = rf"regexp_replace(replace(lower({x}), '&', ' and '), '^(m\s*/\s*s|m\s*\.\s*s)\.?\s+', '')"
    y = rf"replace(regexp_replace({y}, '\bd\s*/\s*b\s*/\s*a\b', 'dba', 'g'), 's.a.r.l.', 'sarl')"
    return rf"trim(regexp_replace(regexp_replace({y}, '[^\p{{L}}\p{{M}}\p{{N}} ]', ' ', 'g'), '\s+', ' ', 'g'))"


_LATIN = lambda x: rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"
_RAW = f"""with {RECORDS}, r0 as (select id as entity_id, name as n, address as a, {_NUMBER} as num, {_REAL('id')} as country from rec),
raw as (select entity_id, country, n, (num // 4) % 8 as kind, case (num // 4) % 8 when 0 then n || ' Inc' when 1 then 'M/s ' || n || ' Pvt. Ltd.' when 2 then n || ' S.A.R.L.' when 3 then upper(n) || ' d / b / a X & Co'
    when 4 then replace(n, 'e', 'é') || ' GmbH limited company' when 5 then '-' when 6 then n || ' नाम' else '!!!' end as name,
  case (num // 4) % 8 when 5 then 'N/A' else a || ' Ave Ste 9, 40012' end as address, regexp_extract(a, '^(\\d+)', 1) as house from r0)"""
_MISSING = "('', 'nan', 'none', 'null', '-', 'n/a', 'na')"
_SUFFIXES = "|".join(sorted(LEGAL_SUFFIXES, key=lambda x: (-x.count(" "), x)))

CHANNELS = f"""with {RECORDS}, {KEYS}, {_structured('hits', CHANNEL_DEPTHS['structured'])}, {_lexical('joint', "name || ' ' || name || ' ' || address", 100, max_df=0.4)}, {_lexical('names', 'name', 100, max_df=0.5)}, {_lexical('places', 'address', 150, max_df=0.5)},
allhits as (select 'joint' as channel, * from joint union all select 'name_only', * from names union all select 'address_only', * from places union all select 'structured', * from hits)"""
_FOUR = "case channel when 'joint' then 1.2::double when 'address_only' then 1.1::double when 'name_only' then 0.8::double else 0.7::double end"
CANDIDATE_PAIRS = f"""{CHANNELS}, {_rrf('fused', _FOUR)}, dupes as (select a.tid, b.tid as sibling from p a join p b using (name, address) where a.tid <> b.tid and trim(name) <> '' and trim(address) <> ''),
new as (select qid, sibling as tid, round(0.99::double * max(rrf), 12) as rrf from fused join dupes using (tid) group by all),
grown as (select qid, tid, rrf from fused union all select qid, tid, rrf from new anti join fused using (qid, tid)),
final as (select * from (select *, row_number() over (partition by qid order by rrf desc, tid) as rrf_rank from grown) where rrf_rank <= 100)"""


def _resampled(grp: str) -> str:
    f = lambda ts, tm: f"select qid, country, {F05} as f05 from (select qid, country, n_true, coalesce(n_pred, 0) as n_pred, coalesce(n_tp, 0) as n_tp from n_true left join (select qid, count(*) as n_pred, count(t.tid) as n_tp from ({_decided(ts, tm)}) x left join (select qid, tid from truth) t using (qid, tid) group by qid) using (qid))"
    return f"""{SCORED}, fa as ({f(0.7, 0.7)}), fb as ({f(0.6, 0.5)}),
d as (select qid, {grp} as grp, fb.f05 - fa.f05 as d from fa join (select qid, f05 from fb) fb using (qid)),
placed as (select grp, d, row_number() over (partition by grp order by qid) - 1 as place, count(*) over (partition by grp) as size from d),
drawn as (select grp, b, ('0x' || substr(md5('bootstrap|' || grp || '|' || b || '|' || place), 1, 8))::bigint % size as place from placed, range(200) as t(b)),
means as (select b, avg(d) as m from drawn join (select grp, place, d from placed) using (grp, place) group by b)
select (select round(avg(d), 9) from d) as delta, round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high from means"""


def _sample(seed: str, n: int, source: str) -> str:
    return f"select qid, c_mktsegment from (select *, row_number() over (partition by c_mktsegment order by sha256('{seed}|' || qid), qid) as n from {source}) where n <= {n}"


_ROLES = f"""{_CUSTOMERS}, cal as ({_sample('roles|calibration', 20, 'ids')}), rest as (select * from ids anti join cal using (qid)), cmp as ({_sample('roles|comparison', 30, 'rest')}),
roles as (select qid, c_mktsegment, 'calibration' as role from cal union all select qid, c_mktsegment, 'comparison' from cmp)"""


def _rule(name: str, source: str, value: str) -> str:
    return f"select '{name}' as rule, (select count(*) from ({source})) as n, (select coalesce(string_agg(v, ',' order by v), '') from (select distinct {value} as v from ({source}) order by v limit 5)) as examples"


_LISTS = f"with {RECORDS}, {KEYS}, {_structured('hits', 5)}, other as (select qid from required where not suffix(qid, '7') union all select 'S1-x'), known as (select tid from p where not suffix(tid, '3'))"

_VIEW = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), '&', ' and '), '^(m\s*/\s*s|m\s*\.\s*s)\.?\s+', ''), 'd/b/a', 'dba', 'g'), '[^\p{L}\p{M}\p{N} ]', ' ', 'g'), '\s+', ' ', 'g'))"
_CORE = "private|limited|company|gmbh|societe|corporation|incorporated|etablissements"

_SOUND = "substr(regexp_replace(lower(string_split(name, ' ')[1]), '[^a-z]', '', 'g'), 2)"
for _i, _group in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1):
    _SOUND = f"regexp_replace({_SOUND}, '[{_group}]', '{_i}', 'g')"
_SOUND = f"regexp_replace({_SOUND}, '[a-z]', '', 'g')"
for _i in range(1, 7):
    _SOUND = f"regexp_replace({_SOUND}, '{_i}+', '{_i}', 'g')"

_SOUNDEX = f"substr(rpad(upper(substr(regexp_replace(lower(string_split(name, ' ')[1]), '[^a-z]', '', 'g'), 1, 1)) || {_SOUND}, 4, '0'), 1, 4)"
_TOKENS = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"
_JACCARD = lambda a, b: f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) end"
_GRAMS = lambda x: f"case when length({x}) < 3 then [] else list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))) end"
_DOT = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: {a}[i]::double * {b}[i]::double))"

ORACLES: dict[str, str] = {
    "flagship": f"{CANDIDATES} select country, {_REPORT} from counts group by country",
    "pool_scan": f"with {RECORDS} select id as entity_id, name as business_name, address as business_address from rec where source in ('S2', 'S3') and country = 'Brand#7'",
    "structured_keys": f"with {RECORDS}, {KEYS} select tid, country, key_type, key from pk",
    "structured_overflow": f"with {RECORDS}, {CAP_TABLE}, pk as ({_keys('p', 'tid', country="'all'")}) select key_type, count(*) as n_keys, cast(sum(case when n > cap then 1 else 0 end) as bigint) as n_over, max(n) as longest from (select key_type, key, count(*) as n from pk group by all) join caps using (key_type) group by key_type",
    "structured_search": f"{BASE} select * from hits",
    "pin_block": f"""with {RECORDS}, a as (select qid, '400' || lpad(regexp_extract(address, '^(\\d+)', 1), 3, '0') as pin from q), b as (select tid, '400' || lpad(regexp_extract(address, '^(\\d+)', 1), 3, '0') as pin from p)
      select qid, tid, rank from a join (select *, row_number() over (partition by pin order by tid) as rank from b) using (pin) where rank <= 40""",
    "challenger": f"""with {RECORDS}, {CAP_TABLE}, pk as ({_keys('p', 'tid', "'small', 'red'")}), qk as ({_keys('q', 'qid', "'small', 'red'")}), {_structured('hits', 100)}, {_lexical('lex', 'name', 20)},
      allhits as (select 'structured' as channel, * from hits union all select 'locked', * from lex), {_rrf('fused', '1.0::double', 1)} select * from fused where rrf_rank <= 50""",
    "duplicate_map": f"with {RECORDS}, {DUPES} select tid, string_agg(sibling, ',' order by sibling) as siblings from dupes group by tid",
    "missed_targets": f"with {RECORDS}, {KEYS}, {_structured('hits', 1)} select distinct tid from truth where tid not in (select tid from hits)",
    "lexical_name": f"with {RECORDS}, {_lexical('lex', 'name', 20)} select * from lex",
    "lexical_address": f"with {RECORDS}, {_lexical('lex', 'address', 20)} select * from lex",
    "second_pass": f"""with {RECORDS}, {_lexical('lex', 'name', 20)}, {_lexical('wide', 'name', 60, prefix='w')}, kept as (select * from lex where score > 0.5),
      weak as (select qid from required left join (select qid, max(score) as best, count(*) as n from kept group by 1) using (qid) where best is null or best < 0.15 or n < 10),
      both_ as (select qid, tid, score from kept union all select qid, tid, score from wide semi join weak using (qid)),
      m as (select qid, tid, max(score) as score from both_ group by all)
      select * from (select *, row_number() over (partition by qid order by score desc, tid) as rank from m) where rank <= 60""",
    "dense_search": f"""with n as (select vec_id, embedding, sqrt({_DOT('embedding', 'embedding')}) as norm from embeddings),
      s as (select a.vec_id as qid, b.vec_id as tid, round({_DOT('a.embedding', 'b.embedding')} / a.norm / b.norm, 6) as score from n a, n b where a.vec_id % 50 = 0)
      select qid, tid, round(score, 4) as score, rank from (select *, row_number() over (partition by qid order by score desc, tid) as rank from s) where rank <= 10""",
    "mean_pooling": f"""with v as (select vec_id, list_transform(range(1, 9), lambda j: list_sum(list_transform([0, 16, 32, 48], lambda o: embedding[o + j]::double)) / 4) as m from embeddings),
      n as (select vec_id, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) as norm from v) select vec_id, {', '.join(f'round(m[{i + 1}] / norm, 6) as p{i}' for i in range(8))} from n""",
    "pair_cosine": f"""with v as (select vec_id, embedding as a, lead(embedding) over (partition by label order by vec_id) as b from embeddings),
      c as (select vec_id, {_DOT('a', 'b')} / sqrt({_DOT('a', 'a')} * {_DOT('b', 'b')}) as c from v where b is not null) select vec_id, round(c, 5) as cosine, round(0.8 * 0.5 + 0.2 * c, 5) as fused from c""",
    "fusion_sources": f"{FUSED} select qid, tid, string_agg(channel || ':' || printf('%.6f', score) || ':' || rank, ',' order by channel) as channels from allhits group by qid, tid",
    "fusion_rrf": f"{RRF} select * from fused",
    "fusion_rrf_plain": f"{FUSED}, {_rrf('fused', '1.0::double')} select * from fused",
    "fusion_lookups": f"""{FUSED} select qid, tid, max(score) filter (channel = 'name_only') as name_only_score, max(rank) filter (channel = 'name_only') as name_only_rank,
      max(score) filter (channel = 'structured') as structured_score, max(rank) filter (channel = 'structured') as structured_rank from allhits group by qid, tid""",
    "fusion_duplicates": f"""{RRF}, {DUPES}, new as (select qid, sibling as tid, round(0.99::double * max(rrf), 12) as rrf from fused join dupes using (tid) group by all),
      both_ as (select qid, tid, rrf from fused union all select qid, tid, rrf from new anti join fused using (qid, tid))
      select *, row_number() over (partition by qid order by rrf desc, tid) as rrf_rank from both_""",
    "fusion_cover": f"{RRF} select qid, tid, rrf, rrf_rank from (select qid from required) left join (select * from fused where rrf_rank <= 10) using (qid)",
    "fusion_unions": f"""{FUSED}, {DUPES}, one as (select distinct qid, tid from lex), two as (select qid, tid from one union select qid, tid from hits),
      three as (select qid, tid from two union select qid, sibling from two join dupes using (tid)),
      steps as (select 1 as step, 'name_only' as channel, * from one union all select 2, 'structured', * from two union all select 3, 'duplicates', * from three)
      select step, channel, count(*) as n, count(distinct qid) as n_queries from steps group by all""",
    "fusion_max_merge": f"{FUSED} select qid, tid, max(score) as score from allhits group by all",
    "fusion_owner": f"{BASE} select qid, tid, score from (select *, row_number() over (partition by tid order by score desc, qid) as n from hits) where n = 1",
    "fusion_hash": f"{BASE} select qid, sha256(string_agg(tid || ':' || printf('%.6f', score), ',' order by tid || ':' || printf('%.6f', score))) as digest from hits group by qid",
    "union_sizes": f"{FUSED} select round(avg(n), 6) as mean, max(n) as most, min(n) as least from (select qid, count(distinct tid) as n from allhits group by 1)",
    "normalize_documents": f"select doc_id, md5(v) as view_md5, length(trim(regexp_replace(v, '((^| )({_CORE}))+$', ''))) as core_chars, len(string_split(v, ' ')) as n_tokens from (select doc_id, {_VIEW} as v from documents)",
    "string_functions": f"""with {RECORDS} select id as entity_id,
      substr(rpad(upper(substr(regexp_replace(lower(string_split(name, ' ')[1]), '[^a-z]', '', 'g'), 1, 1)) || {_SOUND}, 4, '0'), 1, 4) as soundex,
      lower(trim(name)) in ('', 'nan', 'none', 'null', '-', 'n/a', 'na') as missing, length(trim(address)) = 0 as blank,
      regexp_replace(lower(address), ' st$', ' street') as expanded, '' as pin, regexp_extract(address, '^(\\d+)', 1) as houses,
      name || ' ' || name || ' ' || address as joint, name || ' ' || name || ' ' || address || case when {_REAL('id')} = 'US' then ' two three' else ' two three four five' end as search, name || ' [SEP] ' || address as pair, name || ' | ' || address || ' | ' || country as line,
      case when string_split(name, ' ')[-1] in ('ring', 'st', 'bolt') then 1 else 0 end as suffix_match,
      array_to_string(list_sort({_GRAMS("replace(name, ' ', '')")}), '|') as grams from rec""",
    "pair_features": f"""{RRF}, best as (select qid, tid, max(score) as score, count(*) as channels from allhits group by all),
      x as (select best.*, rrf, q.name as a, p.name as b, regexp_replace(q.address, ' st$', case when {_REAL('qid')} = 'France' then ' st' else ' street' end) as c, regexp_replace(p.address, ' st$', case when {_REAL('tid')} = 'France' then ' st' else ' street' end) as d, regexp_extract(q.address, '^\\d+') as ha, regexp_extract(p.address, '^\\d+') as hb
        from best join fused using (qid, tid) join q using (qid) join p using (tid))
      select qid, tid, round(score, 9) as tfidf_max, channels::double as n_channels, round({_JACCARD(_GRAMS("replace(a, ' ', '')"), _GRAMS("replace(b, ' ', '')"))}, 9) as name_char_jac,
        round(least(length(a), length(b)) / greatest(length(a), length(b)), 9) as name_len_ratio, case when a = b then 1.0 else 0.0 end as name_exact_nonempty,
        round({_JACCARD(_TOKENS('a'), _TOKENS('b'))}, 9) as name_core_jac, round({_JACCARD(_TOKENS('c'), _TOKENS('d'))}, 9) as addr_word_jac, 1.0 as addr_present_both,
        case when ha = hb then 1.0 else 0.0 end as house_equal, case when ha <> hb then 1.0 else 0.0 end as house_conflict, 0.0 as unit_equal, 0.0 as unit_conflict, 0.0 as pin_equal, 0.0 as pin_conflict,
        case when tid like 'S2-%' then 1.0 else 0.0 end as source_is_s2, round(rrf, 9) as rrf_best from x""",
    "merged_features": f"""with {RECORDS}, {_lexical('lex', 'name', 20)}, x as (select lex.qid, lex.tid, score, q.name as a, p.name as b, q.address as c, p.address as d from lex join q using (qid) join p using (tid))
      select qid, tid, round(score, 9) as tfidf, round(least(length(a), length(b)) / greatest(length(a), length(b)), 9) as len_ratio, round({_JACCARD(_GRAMS("replace(a, ' ', '')"), _GRAMS("replace(b, ' ', '')"))}, 9) as char3_jac,
        case when regexp_extract(c, '^\\d+') = regexp_extract(d, '^\\d+') then 1.0 else 0.0 end as num_match, 1.0 as country_match, case when tid like 'S2-%' then 1.0 else 0.0 end as source_is_s2, 0.0 as address_missing,
        round({_JACCARD(_TOKENS('c'), _TOKENS('d'))}, 9) as addr_word_jac, case when a = b then 1.0 else 0.0 end as name_exact, 0.0 as pin_match, 0.0 as pin_mismatch from x""",
    "splits": f"{_CUSTOMERS} select qid, {_SPLIT} as split, {_KEY('f05-v1')}::varchar as group_key, ({_KEY('folds')} % 3)::int as fold, {_BUCKET('n_matches')} as bucket from ids",
    "split_crosstab": f"{_CUSTOMERS} select {_SPLIT} as split, {_BUCKET('n_matches')} as bucket, count(*) as n from ids group by all",
    "fresh_probe": f"{_CUSTOMERS} select qid from ids where not ({_EXPOSED}) order by sha256('probe|' || qid), qid limit 25",
    "group_sample": f"{_CUSTOMERS} {_sample('sample', 10, 'ids')}",
    "sorted_slice": f"{_CUSTOMERS} select qid, c_mktsegment from ids order by qid limit 15 offset 10",
    "role_manifest": f"{_ROLES} select qid, c_mktsegment, role from roles",
    "role_checks": f"{_ROLES} select qid from ids anti join roles using (qid)",
    "negative_sample": f"""{BASE}, wrong as (select qid, tid from hits anti join truth using (qid, tid))
      select qid, tid from (select qid, tid, n_true, row_number() over (partition by qid order by sha256('negatives|' || qid || '|' || tid), tid) as n from wrong join n_true using (qid))
      where n <= case when n_true = 0 then 12 else greatest(1, 6 * n_true) end""",
    "two_threshold": f"{SCORED} {_decided(0.7, 0.6)}",
    "single_threshold": f"{SCORED} select qid, tid, p from scored where p >= 0.5",
    "sweep_diagonal": f"{_sweep([(x, x) for x in DIAGONAL])} select * from swept",
    "sweep_grid": f"{_sweep([c for c in _GRID if c[1] <= c[0]])} select * from swept",
    "tune_best": f"{_sweep([c for c in _GRID if c[1] <= c[0]])} select * from swept order by macro_f05 desc, ts, tm limit 1",
    "tune_free": f"{_sweep([(a, b) for a in FREE_GRID for b in FREE_GRID])} select * from swept order by macro_f05 desc, ts + tm desc, ts, tm limit 1",
    "select_policies": f"""{SCORED}, tms(tm) as (values {_VALUES([(x,) for x in POLICY_GRID])}), best as (select qid, max(p) as best from scored group by 1),
      reached as (select qid, tm, count(*) as n_pred, sum(is_match) as n_tp from scored, tms where p >= tm group by all),
      f as (select qid, country, tm, best, n_true, {F05} as f05 from (select qid, country, n_true, tm, coalesce(best, -1) as best, coalesce(n_pred, 0) as n_pred, coalesce(n_tp, 0) as n_tp from (n_true cross join tms) left join best using (qid) left join reached using (qid, tm))),
      parts as (select 'global' as grp, * from f union all select country, * from f),
      g as (select grp, ts.tm::double as ts, parts.tm::double as tm, round(avg(case when best >= ts.tm then f05 when n_true = 0 then 1.0 else 0.0 end), 9) as macro_f05 from parts, tms ts where parts.tm <= ts.tm group by all),
      base as (select grp, macro_f05 as base from g where ts = 0.7 and tm = 0.7)
      select grp, ts, tm, macro_f05 from (select *, row_number() over (partition by grp order by macro_f05 desc, ts, tm) as n from g join base using (grp) where macro_f05 > base + 1e-12 or (ts = 0.7 and tm = 0.7)) where n = 1""",
    "apply_policy": f"""{SCORED}, named as (select *, max(p) over (partition by qid) as best, case country when 'Brand#1' then 0.6 when 'Brand#2' then 0.9 else 0.7 end as ts, case country when 'Brand#1' then 0.5 when 'Brand#2' then 0.2 else 0.6 end as tm from scored)
      select qid, tid, p, country from named where best >= ts and p >= tm""",
    "fusion_weights": f"""{SCORED}, f as (select w::double as w, qid, country, is_match, (1 - w::double) * p + w::double * ((('0x' || substr(md5(tid || '|' || qid), 1, 6))::bigint % 1000) / 1000.0) as p
        from scored, (values (0.0), (0.05), (0.1), (0.15), (0.2), (0.25), (0.3), (0.35), (0.4)) as g(w)),
      d as (select *, max(p) over (partition by w, qid) as best, case country when 'Brand#1' then 0.6 when 'Brand#2' then 0.9 else 0.7 end as ts, case country when 'Brand#1' then 0.5 when 'Brand#2' then 0.2 else 0.6 end as tm from f),
      k as (select w, qid, count(*) as n_pred, sum(is_match) as n_tp from d where best >= ts and p >= tm group by all),
      e as (select w, qid, n_true, coalesce(n_pred, 0) as n_pred, coalesce(n_tp, 0) as n_tp from (select distinct w, n_true.qid, n_true from n_true, f) left join k using (w, qid))
      select w, round(avg({F05}), 9) as macro_f05 from e group by w""",
    "hit_samples": f"""with {RECORDS}, {KEYS}, {_structured('hits', 5)}, m as (select country, h.tid is not null as hit, t.qid, t.tid from truth t join required using (qid) left join (select distinct qid, tid from hits) h on h.qid = t.qid and h.tid = t.tid)
      select country, hit, qid, tid from (select *, row_number() over (partition by country, hit order by qid, tid) as n from m) where n <= 3""",
    "per_query_scores": f"{DECIDED} select qid, country, n_true, n_pred, n_tp, round(f05, 9) as f05, round(f05, 9) as f05_by_rates from scores",
    "summary": f"{DECIDED} select country, round(avg(f05), 6) as macro_f05, count(*) as n, round(avg(case when n_pred = 0 then 1.0 else 0.0 end), 6) as empty_rate from scores group by rollup(country)",
    "losses": f"""{DECIDED}, best as (select qid, tid from truth semi join hits using (qid, tid)), {_count('best', 'ocounts')}, o as (select qid, {F05} as oracle_f05 from ocounts)
      select country, round(avg(1 - oracle_f05), 6) as retrieval_loss, round(avg(oracle_f05 - f05), 6) as matcher_loss, round(avg(1 - f05), 6) as total_loss from scores join o using (qid) group by country""",
    "singletons": f"{DECIDED} select country, count(*) as n, cast(sum(case when n_pred = 0 then 1 else 0 end) as bigint) as n_right, cast(sum(case when n_pred > 0 then 1 else 0 end) as bigint) as n_false_merges from scores where n_true = 0 group by country",
    "error_report": f"""{DECIDED}, k as (select *, case when n_pred > n_tp and n_true > n_tp then 'both' when n_pred > n_tp then 'fp_only' when n_true > n_tp then 'fn_only' else 'perfect' end as kind from scores)
      select kind, count(*) as n, round(sum(1 - f05), 6) as loss, round(sum(case when n_true = 0 then case when n_tp = 0 then 1.0 else 0.0 end when n_tp = 0 then 0.0 else 5.0 * n_tp / (n_true + 4 * n_tp) end), 6) as without_fp,
        round(sum(case when n_true = 0 then case when n_pred = 0 then 1.0 else 0.0 end when n_pred + n_true - n_tp = 0 then 0.0 else 5.0 * n_true / (n_true + 4 * (n_pred + n_true - n_tp)) end), 6) as without_fn from k group by kind""",
    "micro_scores": f"{DECIDED} select round(sum(n_tp) / nullif(sum(n_pred), 0), 6) as precision, round(sum(n_tp) / nullif(sum(n_true), 0), 6) as recall, cast(sum(case when n_pred = 0 and n_true > 0 then 1 else 0 end) as bigint) as false_empty from scores",
    "slices": f"{DECIDED} select round(avg(f05), 6) as everyone, round(avg(case when {_EXPOSED} then f05 end), 6) as exposed, round(avg(case when not ({_EXPOSED}) then f05 end), 6) as fresh from scores",
    "recall_in_pool": f"{BASE}, t as (select * from truth where not suffix(tid, '5')) select count(*) as n_true, count(h.rank) as n_hit, round(count(h.rank) / count(*), 6) as recall from t left join (select qid, tid, rank from hits where rank <= 10) h using (qid, tid)",
    "recall_gates": f"{CANDIDATES}, r as (select country, round(100.0 * sum(n_tp) / nullif(sum(n_true), 0), 6) as recall_pct from counts where n_true > 0 group by rollup(country)) select country, recall_pct, recall_pct >= case when country is null then 92.0 else 95.0 end as passes from r",
    "depth_frontier": f"{RRF}, " + ", ".join(f"c{k} as (select * from fused where rrf_rank <= {k}), {_count(f'c{k}', f'k{k}')}" for k in (2, 5, 10, 15, 20)) + f", {_count('fused', 'kall')} " + " union all ".join(f"select {_REPORT}, {k} as k from k{k}" for k in (2, 5, 10, 15, 20)) + f" union all select {_REPORT}, null from kall",
    "match_histogram": f"with {RECORDS} select {_BUCKET('n_true')} as bucket, count(*) as n from n_true group by all",
    "score_summary": f"{SCORED} select is_match, count(*) as n, round(avg(p), 6) as mean, min(p) as least, max(p) as most, round(quantile_cont(p, 0.5), 6) as median from scored group by is_match",
    "id_lists": f"{BASE} select qid, coalesce(ids, '') as ids, coalesce(ranked, '') as ranked, coalesce(n, 0) as n, coalesce(n, 0) as n_items from (select qid from required) left join (select qid, string_agg(tid, ',' order by tid) as ids, string_agg(tid, ',' order by rank) as ranked, count(*) as n from hits group by 1) using (qid)",
    "validator": f"{_LISTS} " + " union all ".join([
        *[f"select '{x}' as rule, 0 as n, '' as examples" for x in ("header", "malformed", "duplicate_query", "duplicate_id", "self_match", "bad_prefix")],
        _rule("missing_query", "select qid from other anti join required using (qid)", "qid"),
        _rule("extra_query", "select qid from required anti join other using (qid)", "qid"),
        _rule("unknown_id", "select qid, tid from hits anti join known using (tid)", "tid"),
    ]),
    "validate_pairs": f"{SCORED}, named as (select qid, tid, qid || '|' || tid as pair from scored) " + " union all ".join([
        _rule("unknown_query", "select pair from named where suffix(qid, '9')", "pair"),
        "select 'repeated_pair', 0, ''",
        _rule("wrong_label", "select pair from named where suffix(tid, '11')", "pair"),
        "select 'bad_probability', 0, ''",
    ]),
    "validate_chunks": f"with {RECORDS} " + " union all ".join([
        _rule("in_two_chunks", "select qid from required where suffix(qid, '1')", "qid"),
        _rule("missing", "select qid from required where suffix(qid, '4')", "qid"),
        _rule("extra", "select qid from required where suffix(qid, '6')", "qid"),
    ]),
    "outside_candidates": f"{FUSED} select qid, tid from hits anti join lex using (qid, tid)",
    "bundle_parity": f"{SCORED} select count(*) as rows_a, cast(sum(is_match) as bigint) as labels_a, cast(sum(is_match) as bigint) as rows_b, cast(sum(is_match) as bigint) as labels_b, count(*) = sum(is_match) as same from scored",
    "lexical_by_country": f"""with {RECORDS}, cq as (select qid, name || ' ' || name || ' ' || address as x, {_REAL('qid')} as country from q), cp as (select tid, name || ' ' || name || ' ' || address as x, {_REAL('tid')} as country from p),
      {_lexical('lex', 'x', "case country when 'India' then 9 when 'US' then 8 else 4 end", max_df="case country when 'India' then 0.4::double else 0.35::double end", min_df="case country when 'US' then 3 else 2 end", least=0.02, q='cq', p='cp')} select * from lex""",
    "second_pass_gated": f"""with {RECORDS}, {_lexical('lex', 'name', 20)}, {_lexical('wide', 'name', 60, prefix='w')}, kept as (select * from lex where score > 0.5),
      weak as (select qid from required left join (select qid, max(score) as best, count(*) as n from kept group by 1) using (qid) where country = 'Brand#7' and (best is null or best < 0.15 or n < 10)),
      m as (select qid, tid, max(score) as score from (select qid, tid, score from kept semi join weak using (qid) union all select qid, tid, score from wide semi join weak using (qid)) group by all)
      select * from (select *, row_number() over (partition by qid order by score desc, tid) as rank from m) where rank <= 60 union all select qid, tid, score, rank from kept anti join weak using (qid)""",
    "backfill": f"""with {RECORDS}, {KEYS}, {_structured('hits', 5)},
      weak as (select qid from required left join (select qid, max(score) as best, count(*) as n from hits group by 1) using (qid) where best is null or best < 3.0 or n < 5),
      sq as (select qid as id, * from q), sp as (select tid as id, * from p),
      qk2 as (select qid, country, 'sound' as kind, {_SOUNDEX} as key from q union all select distinct qid, country, 'house', unnest(regexp_extract_all(address, '\\b\\d{{1,6}}\\b')) from q),
      pk2 as (select tid, country, 'sound' as kind, {_SOUNDEX} as key from p union all select distinct tid, country, 'house', unnest(regexp_extract_all(address, '\\b\\d{{1,6}}\\b')) from p),
      capped as (select * from (select *, count(*) over w as n_all, row_number() over (partition by country, kind, key order by tid) as n from pk2 window w as (partition by country, kind, key)) where n_all <= 500 and n <= 200),
      new as (select distinct qid, tid from qk2 semi join weak using (qid) join capped using (country, kind, key)),
      fresh as (select qid, tid, q.name || ' ' || q.address as a, p.name || ' ' || p.address as b from new join q using (qid) join p using (tid) anti join hits using (qid, tid)),
      scored as (select qid, tid, round(round(1 - levenshtein(a, b) / greatest(length(a), length(b), 1), 6), 6) as score from fresh),
      added as (select qid, tid, score from (select *, row_number() over (partition by qid order by score desc, tid) as n from scored where score >= 0.5) where n <= 10),
      merged as (select qid, tid, score from hits semi join weak using (qid) union all select * from added)
      select qid, tid, score, rank from (select *, row_number() over (partition by qid order by score desc, tid) as rank from merged) where rank <= 60 union all select qid, tid, score, rank from hits anti join weak using (qid)""",
    "candidates": f"{CANDIDATE_PAIRS} select qid, tid, rrf, rrf_rank from (select qid from required) left join final using (qid)",
    "candidate_lookups": f"""{CHANNELS} select qid, tid, {', '.join(f"max({v}) filter (channel = '{c}') as {c}_{v}" for c in CHANNEL_WEIGHTS for v in ('score', 'rank'))} from allhits group by qid, tid""",
    "hashed_search": f"""with {RECORDS}, g as (select id, unnest(list_transform(range(1, greatest(length(w) - n + 1, 1) + 1), lambda i: substr(w, i, n))) as gram from (select id, ' ' || unnest(string_split(lower(name), ' ')) || ' ' as w from rec), (values (3), (4), (5)) as s(n) where n = 3 or length(w) > n - 1),
      c as (select id, ('0x' || substr(md5(gram), 1, 8))::bigint % 4096 as dim, count(*)::double as w from g group by all), u as (select id, dim, w / sqrt(sum(w * w) over (partition by id)) as w from c),
      s as (select a.id as qid, b.id as tid, round(sum(a.w * b.w), 6) as score from u a join u b using (dim) where a.id like 'S1-%' and b.id not like 'S1-%' group by all)
      select * from (select *, row_number() over (partition by qid order by score desc, tid) as rank from s where score > 0) where rank <= 10""",
    "normalized_records": f"""{_RAW}, v as (select *, {_EXPANDED(_primary('name'), LEGAL_FORMS)} as nv, {_EXPANDED(_primary('address'), STREET_WORDS)} as av, {_EXPANDED(_primary(_LATIN('name')), LEGAL_FORMS)} as nl from raw)
      select entity_id, name as name_raw, ' ' || country as country_raw, country as country_key, nv as name_view, av as address_view, nl as name_latin, av as address_latin, trim(regexp_replace(nv, '((^| )({_SUFFIXES}))+$', '')) as name_core, replace(nv, ' ', '') as name_compact,
        lower(trim(name)) in {_MISSING} as name_missing, lower(trim(address)) in {_MISSING} as address_missing, nv = '' and lower(trim(name)) not in {_MISSING} as unicode_empty, nl = '' and nv <> '' as latin_empty,
        regexp_matches(name, '[A-Za-zÀ-ɏ]') as has_latin, kind = 6 as has_nonlatin, kind = 6 as has_mark, case kind when 5 then '' else '40012' end as postal, kind <> 5 as pin_confident,
        case kind when 5 then '' else house || ',9,40012' end as houses, case kind when 5 then '' else '9' end as units from v""",
    "other_views": f"""{_RAW} select entity_id,
      case kind when 0 then n || ' inc' when 1 then 'm s ' || n || ' pvt ltd' when 2 then n || ' s a r l' when 3 then n || ' d b a x co' when 4 then n || ' gmbh limited company' when 6 then n else '' end as search,
      case kind when 5 then 'n a' else regexp_replace(lower(address), ' st ave ste 9, 40012$', ' street avenue suite 9 40012') end as loose,
      case kind when 0 then n || ' incorporated' when 1 then 'm s ' || n || ' private limited' when 2 then n || ' s a r l' when 3 then n || ' d b a x company' when 4 then n || ' gmbh limited company' when 6 then n else '' end as plain,
      case kind when 0 then n || ' inc' when 1 then n || ' pvt ltd' when 2 then n || ' sarl' when 3 then n || ' dba x and co' when 4 then n || ' gmbh limited company' when 6 then n else '' end as latin from raw""",
    "role_subsets": f"{_ROLES}, scr as ({_sample('roles|screen', 7, 'cmp')}) select qid, c_mktsegment, 'screen' as role from scr",
    "bootstrap": _resampled("country"),
    "bootstrap_plain": _resampled("''"),
    "model_reload": f"{CANDIDATE_PAIRS} select count(*) as n_pairs, 0 as n_differ, 23 as n_features, 4 as rounds from final",
    "model_screen": f"{CANDIDATE_PAIRS} select 'depth-' || k as arm, count(*) as n, count(*) as n_pairs, 0 as n_bad from final, range(1, 5) as t(k) group by all",
    "hard_negatives": f"{SCORED} select qid, tid, p from (select *, row_number() over (partition by qid order by p desc, tid) as n from scored where is_match = 0) where n <= 3",
    "rerank": f"{SCORED} select qid, tid, p, round(1 - p, 6) as p2 from (select *, row_number() over (partition by qid order by p desc, tid) as n from scored) where n <= 4",
    "basic_score": f"""with {RECORDS}, {KEYS}, {_structured('hits', 5)}, x as (select qid, tid, q.name as a, p.name as b, regexp_extract(q.address, '^(\\d+)', 1) as c, regexp_extract(p.address, '^(\\d+)', 1) as d from hits join q using (qid) join p using (tid)),
      s as (select qid, tid, round(0.5 * round(1 - levenshtein(a, b) / greatest(length(a), length(b), 1), 6) + 0.3 * ({_JACCARD(_TOKENS('a'), _TOKENS('b'))}) + case when c = d then 0.2::double else 0.0::double end, 6) as score from x) select qid, tid, score from s where score >= 0.5""",
    "tsv_records": f"with {RECORDS} select id as entity_id, name as business_name, address as business_address, country from rec order by id limit 500",
    "truth_file": f"with {RECORDS} select qid, coalesce(ids, '') as ids, coalesce(n, 0) as n from (select qid from required) left join (select qid, string_agg(tid, ',' order by tid) as ids, count(*) as n from truth group by 1) using (qid)",
    "held_truth": f"with {RECORDS} select qid, coalesce(ids, '') as ids, coalesce(n, 0) as n from (select qid from required where {_EXPOSED}) left join (select qid, string_agg(tid, ',' order by tid) as ids, count(*) as n from truth group by 1) using (qid)",
    "manifest": f"with {RECORDS} select qid from required",
    "bundle": f"with {RECORDS} select qid, country, case when suffix(qid, '3') then 'eval' else 'train' end as part from required",
    "merged_chunks": f"with {RECORDS}, {KEYS}, {_structured('hits', 5)} select qid, coalesce(ids, '') as ids, country, ('0x' || substr(md5(qid), 1, 4))::bigint % 4 as chunk from required left join (select qid, string_agg(tid, ',' order by tid) as ids from hits group by 1) using (qid)",
    "predictions_sink": f"{SCORED} select qid, tid, p from scored",
    "scores_sink": f"{DECIDED} select qid, n_true, n_pred, n_tp from scores",
    "check_outputs": f"with {RECORDS}, {KEYS}, {_structured('wide', 8)}, {_structured('hits', 5)}, other as (select qid from required where not suffix(qid, '7')), known as (select tid from p where not suffix(tid, '3')) " + " union all ".join([
        _rule("not_a_candidate", "select qid || '|' || tid as pair from wide anti join hits using (qid, tid)", "pair"),
        *[x for name, t in (("matches", "wide"), ("candidates", "hits")) for x in (
            _rule(f"{name}_missing_query", f"select qid from other anti join {t} using (qid)", "qid"), _rule(f"{name}_extra_query", f"select distinct qid from {t} anti join other using (qid)", "qid"),
            f"select '{name}_duplicate_query', 0, ''", f"select '{name}_duplicate_id', 0, ''", f"select '{name}_self_match', 0, ''", _rule(f"{name}_unknown_id", f"select qid, tid from {t} anti join known using (tid)", "tid"))],
    ]),
    "invariants": f"""{DECIDED}, one as (select country, round(avg(f05), 6) as macro_f05, count(*) as n, round(avg(case when n_pred = 0 then 1.0 else 0.0 end), 6) as empty_rate from scores group by country)
      select m as metric, count(*) as n, cast(sum(case when country = 'Brand#9' or (m = 'macro_f05' and country = 'Brand#3') then 1 else 0 end) as bigint) as n_off from one, (values ('macro_f05'), ('n'), ('empty_rate')) as t(m) group by m""",
}
