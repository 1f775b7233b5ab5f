"""SQL for DuckDB that says what each query of the catalogue returns."""

from __future__ import annotations

from ..functions.text import KANA_CJK, SPACE, WORD

_STRIP = lambda x: f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_COLLAPSE = lambda x: f"regexp_replace(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'), '^ | $', '', 'g')"
_SQUASH = lambda x: f"regexp_replace({x}, '[{SPACE}]+', '', 'g')"

def _quoted(x: str) -> str:
    """What ``functions.text.quoted`` says."""
    out = f"replace({x}, chr(92), chr(92) || chr(92))"
    for code in [*range(1, 32), 127]:
        out = f"replace({out}, chr({code}), chr(92) || '{ {9: 't', 10: 'n', 13: 'r'}.get(code, f'x{code:02x}') }')"
    return f"(case when contains({x}, chr(39)) and not contains({x}, chr(34)) then chr(34) || {out} || chr(34) else chr(39) || replace({out}, chr(39), chr(92) || chr(39)) || chr(39) end)"


_LINES = f"""lines as (select doc_id, pos - 1 as pos, text from (select doc_id, unnest(l) as text, generate_subscripts(l, 1)::bigint as pos
  from (select doc_id, string_split(text, chr(10)) as l from documents)) where {_STRIP("text")} <> '')"""

_SECONDS = "(epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6::double"


def _root(x: str) -> str:
    c = f"lower(regexp_replace({x}, '[^{WORD}{KANA_CJK}]', '', 'g'))"
    arms = " ".join(f"when {w} <= length(c) and length(c) % {w} = 0 and repeat(substr(c, 1, {w}), (length(c) // {w})::int) = c then substr(c, 1, {w})" for w in range(1, 9))
    return f"(select case when c = '' then c {arms} else c end from (select {c} as c))"


def _runs(rows: str, keys: str, text: str) -> str:
    """Longest run of one character of each row."""
    return f"""(select {keys}, max(n) as run from (select {keys}, c, count(*) as n from (select {keys}, i, c, i - row_number() over (partition by {keys}, c order by i) as g
      from (select {keys}, unnest(range(1, length(c) + 1)) as i, unnest(string_split(c, '')) as c from (select {keys}, {text} as c from {rows})) where c <> '') group by {keys}, c, g) group by {keys})"""


_BAD = f"""case when c = '' then 'empty cue' when coalesce(run, 1) >= 12 then 'single character repeated ' || run || ' times'
  when regexp_extract(c, '[0-9]{{4,}}') <> '' then 'unexpected Latin text in Japanese transcript: ''' || regexp_extract(c, '[0-9]{{4,}}') || ''''
  when length(c) > 120 then 'implausibly long cue (' || length(c) || ' characters)' end"""

_JUDGED = f"""{_LINES}, squashed as (select doc_id, pos, text, {_SQUASH("text")} as c from lines), runs as {_runs("squashed", "doc_id, pos", "c")},
  judged as (select doc_id, pos, text, {_BAD} as error from squashed left join runs using (doc_id, pos))"""


def _islands(value: str, rows: str, part: str, order: str) -> str:
    return f"""(select *, count(*) over (partition by {part}, isl) as run from (select *, sum(new) over (partition by {part} order by {order} rows unbounded preceding) as isl
      from (select *, case when v is not distinct from lag(v) over (partition by {part} order by {order}) then 0 else 1 end as new from (select *, {value} as v from {rows}))))"""


_TRACKS = """s as (select conv_id as media_id, row_number() over (partition by conv_id order by turn) as idx, turn::varchar as timing, text from conversations where role = 'user'),
  t as (select conv_id as media_id, row_number() over (partition by conv_id order by turn) as idx, (turn - 1)::varchar as timing, text from conversations where role = 'assistant')"""
_FITS = f"coalesce(s.timing = t.timing and {_STRIP('t.text')} <> '', false)"
_PAIRS = "s full outer join t using (media_id, idx)"

_FRAMES = "f as (select vec_id, label, list_transform(embedding, lambda x: round_even(x::double * 32767, 0)::bigint) as x from embeddings)"


def _dbfs(x: str) -> str:
    return f"coalesce(20 * log10(greatest(sqrt(list_sum(list_transform({x}, lambda v: v * v))::double / len({x})), 1.0) / 32768), -120.0)"


def _stamp(seconds: str) -> str:
    ms = f"greatest(0, round_even({seconds} * 1000, 0)::bigint)"
    return f"(select printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) from (select {ms} as ms))"


_COMPACT = lambda x: rf"length(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
_LEFT, _IDEO = "[#$%&*]", "[A-Za-z]"

_REASONS = f"""list_filter([
  case when t.text = '(unclear)' then 'unclear fallback' end,
  case when {_STRIP("s.text")} = {_STRIP("t.text")} then 'unchanged source' end,
  case when regexp_matches(t.text, '{_LEFT}') then 'Japanese script' end,
  case when (regexp_matches(s.text, '{_LEFT}') or regexp_matches(s.text, '{_IDEO}')) and not regexp_matches(t.text, '{_IDEO}') then 'no Chinese script' end,
  case when {_COMPACT("s.text")} >= 4 and {_COMPACT("t.text")} / {_COMPACT("s.text")} < 0.45 then 'unusually short' end,
  case when {_COMPACT("s.text")} >= 4 and {_COMPACT("t.text")} / {_COMPACT("s.text")} > 2.2 then 'unusually long' end,
  case when length({_STRIP("s.text")}) <= 18 and (regexp_matches({_STRIP("s.text")}, '(?:the|la|der|de)$') or regexp_matches(s.text, ' it | he | die | que ')) then 'context-sensitive fragment' end
], lambda x: x is not null)"""



def _capped(rows: str, cap: float, stride: float, gap: float, out: str) -> str:
    """Padded rows (user_id, s, e) folded one by one in their order: l and m are the open interval, h and t what was closed before it."""
    return f"""o as (select user_id, s, e, row_number() over (partition by user_id order by s, e) as i, greatest(0, ceil((e - s - {cap}) / {stride})::int) as n from {rows}),
      w as (select user_id, i, s + n * {stride} as l, e as m, n, s, null::double as h, null::double as t, 1 as opens from o where i = 1
        union all select o.user_id, o.i, case when j then l else o.s + o.n * {stride} end, case when j then greatest(m, o.e) else o.e end, o.n, o.s, case when not j then l end, case when not j then m end, case when j then 0 else 1 end
        from (select w.user_id, w.i, l, m, o.s - m <= {gap} and o.e - l <= {cap} as j from w join o on o.user_id = w.user_id and o.i = w.i + 1) x join o on o.user_id = x.user_id and o.i = x.i + 1),
      z as (select user_id, i, 0 as k, h as a, t as b from w where h is not null
        union all select user_id, i, k, s + (k - 1) * {stride}, s + (k - 1) * {stride} + {cap} from (select *, unnest(range(1, n + 1)) as k from w where opens = 1)
        union all select user_id, i + 1, 0, l, m from w where i = (select max(i) from o where o.user_id = w.user_id)),
      {out} as (select user_id, row_number() over (partition by user_id order by i, k) - 1 as interval_no, a as start, b as "end" from z where b - a >= 0.2)"""


TWINS = {
    "line_cues": f"with {_LINES} select doc_id, row_number() over (partition by doc_id order by pos) as idx, {_COLLAPSE('text')} as text from lines",
    "quality_text_rules": f"with {_JUDGED} select doc_id, pos, error from judged",
    "repetition_root": f"""with w as (select distinct unnest(string_split(text, ' ')) as w from benchmark),
      x as (select w as text from w union select w || w from w union select w || ' ' || w || '-' || w from w) select text, {_root("text")} as root from x""",
    "burst_filter": f"""with {_LINES}, r as (select * from (select doc_id, pos, text, {_root("text")} as r from lines) where r <> '')
      select doc_id, pos, text from {_islands("r", "r", "doc_id", "pos")} where not (run >= 4 and length(r) <= 6)""",
    "exact_burst_filter": f"with {_LINES} select doc_id, pos, text from {_islands(_COLLAPSE('text'), 'lines', 'doc_id', 'pos')} where run < 4",
    "transcript_rules": f"""with {_JUDGED}, i as (select * from {_islands(_COLLAPSE("text"), "judged", "doc_id", "pos")}),
      per as (select doc_id, v, count(*) as n, min(pos) as f, max(run) as longest, count(distinct isl) as isls from i group by doc_id, v),
      bad as (select doc_id, count(*) as bads, array_to_string(list(pos || ': ' || error order by pos)[1:5], ', ') as preview from judged where error is not null group by doc_id),
      s as (select doc_id, sum(n)::bigint as cues, max(longest)::bigint as longest_run, sum(n - isls)::bigint as adjacent, first(v order by n desc, f) as dominant_text,
        max(n)::bigint as dominant_count, coalesce(sum(n) filter (not regexp_matches(v, '[{WORD}{KANA_CJK}]')), 0)::bigint as punctuation_only from per group by doc_id),
      j as (select s.*, coalesce(bads, 0)::bigint as bad_cues, coalesce(preview, '') as bad_preview from s left join bad using (doc_id)),
      e as (select *, array_to_string(list_filter([
        case when bad_cues > 0 then bad_cues || ' internally repetitive cue(s): ' || bad_preview end,
        case when longest_run >= 25 then 'repetition loop: ' || longest_run || ' consecutive identical cues' end,
        case when cues >= 30 and adjacent / (cues - 1) > 0.2 then 'more than 20% adjacent cues are identical' end,
        case when dominant_count >= 50 and dominant_count / cues > 0.2 then 'one cue dominates transcript (' || dominant_count || '/' || cues || '): ' || {_quoted("dominant_text")} end,
        case when cues >= 100 and punctuation_only / cues > 0.1 then 'more than 10% of cues contain punctuation only' end], lambda x: x is not null), ' | ') as errors from j)
      select d.doc_id, coalesce(cues, 0) as cues, longest_run, adjacent, dominant_text, dominant_count, punctuation_only, bad_cues, bad_preview,
        coalesce(errors, 'transcript contains zero cues') as errors from (select distinct doc_id from documents) d left join e using (doc_id)""",
    "adjacent_context": """select conv_id, turn, coalesce(lag(text) over w, '(start)') as previous, coalesce(lead(text) over w, '(end)') as following from conversations
      window w as (partition by conv_id order by turn)""",
    "context_window": """with r as (select conv_id, text, row_number() over w as rn, list(text) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding) as b,
        list(text) over (partition by conv_id order by turn rows between 1 following and 3 following) as a from conversations window w as (partition by conv_id order by turn))
      select conv_id, ((rn - 1) // 2)::bigint as batch_no, coalesce(array_to_string(min_by(coalesce(b, []), rn), '¦'), '') as context_before, string_agg(text, '¦' order by rn) as texts,
        coalesce(array_to_string(max_by(coalesce(a, []), rn), '¦'), '') as context_after from r group by conv_id, (rn - 1) // 2""",
    "decode_windows": """with d as (select doc_id, n_chars / 2 as duration from documents where n_chars > 0),
      w as (select *, unnest(range(ceil(duration / 28)::bigint)) as window_no from d)
      select doc_id, duration, window_no, window_no * 28.0::double as start, least(duration, window_no * 28.0::double + 30) as "end",
        case when window_no = 0 then 0.0::double else window_no * 28.0::double + 1 end as owned_start,
        case when window_no = ceil(duration / 28) - 1 then least(duration, window_no * 28.0::double + 30) else least(duration, window_no * 28.0::double + 30) - 1 end as owned_end from w""",
    "chunk_windows": """with d as (select doc_id, n_chars / 2 as duration from documents),
      w as (select *, unnest(range(greatest(1, ceil(duration / 300)::bigint))) as chunk_no from d),
      b as (select *, chunk_no * 300.0::double as ns, least(duration, chunk_no * 300.0::double + 300) as ne from w),
      c as (select *, greatest(0.0::double, ns - 1) as ds, least(duration, ne + 1) as de from b)
      select doc_id, duration, chunk_no, ds as decode_start, de - ds as decode_duration, ns - ds as owned_start, ne - ds as owned_end from c""",
    "owned_segments": f"""with e as (select *, s + value as e from (select event_id, user_id, value, {_SECONDS} as s from events)),
      d as (select user_id, max(e) as d from e group by user_id),
      x as (select e.*, d, unnest(list_distinct([floor((s - 1) / 300), floor(s / 300), floor((s + 1) / 300)]))::bigint as k from e join d using (user_id)),
      b as (select *, k * 300.0::double as ns, least(d, k * 300.0::double + 300) as ne from x where k >= 0 and k < greatest(1, ceil(d / 300))),
      c as (select *, greatest(0.0::double, ns - 1) as ds, least(d, ne + 1) as de from b)
      select event_id, k as chunk_no, round(s - ds + ds, 3) as start, round(e - ds + ds, 3) as "end" from c
      where s >= ds and s < ds + (de - ds) and (s - ds + (e - ds)) / 2 >= ns - ds and (s - ds + (e - ds)) / 2 < ne - ds""",
    "activity_merge": f"""with e as (select user_id, s, s + 60 as e from (select user_id, {_SECONDS} as s from events)),
      o as (select *, case when s - lag(e) over w <= 3600 then 0 else 1 end as new from e window w as (partition by user_id order by s, e)),
      i as (select *, sum(new) over (partition by user_id order by s, e rows unbounded preceding) as isl from o)
      select user_id, round(min(s), 3) as start, round(max(e), 3) as "end" from i group by user_id, isl having max(e) - min(s) >= 100""",
    "interval_coverage": f"""with e as (select event_id, user_id, event_type, s, s + value * 60 as e from (select *, {_SECONDS} as s from events)),
      j as (select a.event_id, a.user_id, a.s, a.e, coalesce(sum(least(a.e, b.e) - greatest(a.s, b.s)) filter (b.s is not null), 0) as c from (select * from e where event_type = 'click') a
        left join (select * from e where event_type = 'view') b on a.user_id = b.user_id and b.s < a.e and b.e > a.s group by all)
      select event_id, user_id, round(least(1.0, c / greatest(0.001, e - s)), 6) as coverage, least(1.0, c / greatest(0.001, e - s)) < 0.2 as low from j""",
    "capped_merge": f"""with recursive e as (select user_id, greatest(0.0::double, s - 1) as s, least(2592000.0::double, s + value + 1) as e from (select user_id, value, {_SECONDS} as s from events)),
      {_capped("e", 900.0, 840.0, 600.0, "r")} select user_id, interval_no::int as interval_no, start, "end" from r""",
    "rescue_windows": f"""with recursive b as (select event_id, user_id, event_type, value, s, s + value as e from (select *, {_SECONDS} as s from events)),
      d as (select user_id, max(e) as d from b group by user_id),
      c as (select p.user_id, p.s, p.e, sum(least(p.e, q.e) - greatest(p.s, q.s)) filter (q.s is not null) as covered from (select distinct user_id, s, e from b where event_type = 'purchase') p
        left join (select * from b where event_type = 'click' and e > s) q on q.user_id = p.user_id and q.s < p.e and q.e > p.s group by all),
      u as (select p.user_id, p.s, p.e from b p join c using (user_id, s, e) where p.event_type = 'purchase' and least(1.0, coalesce(covered, 0) / greatest(0.001, p.e - p.s)) < 0.2
        union all select user_id, s, e from b where event_type = 'click' and -value / 50 < -0.85),
      v as (select user_id, greatest(0.0::double, s - 1) as s, least(d, e + 1) as e from u join d using (user_id)),
      {_capped("v", 15.0, 14.0, 0.5, "r")} select user_id, interval_no::int as interval_no, start, "end" from r""",
    "rescue_merge": f"""with recursive b as (select user_id, event_type, event_id as seq, s, s + value * 60 as e, -value / 50 as p from (select *, {_SECONDS} as s from events)),
      c as (select *, row_number() over (partition by user_id order by seq) as i from b where event_type = 'view'),
      u as (select distinct user_id from b where event_type in ('click', 'view')),
      f as (select user_id, 0::bigint as i, coalesce((select list({{'s': s, 'e': e, 'p': p, 'seq': seq, 'text': event_type}} order by seq) from b where b.user_id = u.user_id and event_type = 'click'), []) as l from u
        union all select user_id, i, case when len(hits) = 0 then list_append(l, one) when len(hits) = 1 and l[hits[1]].p < -0.85 and one.p > l[hits[1]].p + 0.1
            then list_concat(list_append(l[1 : hits[1] - 1], one), l[hits[1] + 1 :]) else l end
        from (select f.user_id, c.i, f.l, {{'s': c.s, 'e': c.e, 'p': c.p, 'seq': c.seq, 'text': c.event_type}} as one,
            list_filter(range(1, len(f.l) + 1), lambda k: greatest(0, least(c.e, f.l[k].e) - greatest(c.s, f.l[k].s)) >= 0.3 * greatest(0.1, least(c.e - c.s, f.l[k].e - f.l[k].s))) as hits
          from f join c on c.user_id = f.user_id and c.i = f.i + 1)),
      g as (select user_id, arg_max(l, i) as l from f group by user_id),
      h as (select user_id, unnest(l) as r, generate_subscripts(l, 1) as k from g)
      select user_id, (row_number() over (partition by user_id order by r.s, r.e, k) - 1)::int as "order", r.seq as seq, r.s as start, r.e as "end", r.text as text, r.p as avg_logprob from h""",
    "frame_levels": f"""with {_FRAMES}, p as (select vec_id, x, unnest(range(11)) as frame from f)
      select vec_id, frame, round(frame * 6 / 64, 6) as start, round(least(64, frame * 6 + 6) / 64, 6) as "end", round({_dbfs("x[frame * 6 + 1 : least(64, frame * 6 + 6)]")}, 6) as dbfs from p""",
    "sample_activity": f"""with {_FRAMES}, p as (select vec_id, x, unnest(range(11)) as k from f),
      q as (select vec_id, k * 6 / 64 as a, least(64, k * 6 + 6) / 64 as b from p where {_dbfs("x[k * 6 + 1 : least(64, k * 6 + 6)]")} >= -18),
      o as (select *, case when a - lag(b) over w <= 0.2 then 0 else 1 end as new from q window w as (partition by vec_id order by a)),
      i as (select *, sum(new) over (partition by vec_id order by a rows unbounded preceding) as isl from o)
      select vec_id, round(min(a), 6) as start, round(max(b), 6) as "end" from i group by vec_id, isl having max(b) - min(a) >= 0.2""",
    "srt_serialize": f"""with {_LINES}, n as (select doc_id, pos, text, row_number() over (partition by doc_id order by pos) as idx from lines)
      select doc_id, string_agg(idx || chr(10) || {_stamp("pos * 1.5")} || ' --> ' || {_stamp("(pos * 1.5 + 1)")} || chr(10) || {_STRIP("text")}, chr(10) || chr(10) order by idx) || chr(10) as content from n group by doc_id""",
    "provenance_upsert": """with d as (select doc_id, sha256(doc_id || '|' || coalesce(lang, 'None')) as a, sha256(doc_id || '|' || coalesce(source, 'None')) as b from documents),
      r as (select doc_id, a as f from d where doc_id % 3 <> 0), n as (select doc_id, case when doc_id % 4 = 0 then a else b end as f from d where doc_id % 2 = 0)
      select doc_id, f as fingerprint, false as replaced from n union all select doc_id, f, false from r where doc_id not in (select doc_id from n)
      union all select r.doc_id, r.f, true from r join n using (doc_id) where r.f <> n.f""",
    "frame_dbfs": f"with {_FRAMES} select vec_id, round({_dbfs('x')}, 6) as dbfs from f",
    "clipping_ratio": f"with {_FRAMES} select vec_id, round(len(list_filter(x, lambda v: abs(v) >= 5000)) / len(x), 6) as ratio from f",
    "interval_levels": f"""with {_FRAMES}, p as (select vec_id, unnest(range(5)) as part, x from f)
      select vec_id, part, round(case when part = 4 then -120.0 else {_dbfs("x[part * 16 + 1 : part * 16 + 16]")} end, 6) as dbfs from p""",
    "foreground_filter": f"""with {_FRAMES}, h as (select vec_id, label, unnest([0, 1])::bigint as seq, x from f), l as (select vec_id, label, seq, {_dbfs("x[seq * 32 + 1 : seq * 32 + 32]")} as dbfs from h)
      select vec_id, seq, round(dbfs, 6) as dbfs from l where dbfs >= -18 or (dbfs >= -19 and -label / 10 >= -0.55 and label % 3 <> 0)""",
    "segment_cues": f"""with {_JUDGED}, g as (select doc_id, pos, pos * 2.0::double as s, pos * 2.0::double + pos % 13 as e, {_COLLAPSE("text")} as text from judged where error is null),
      k as (select * from g where e > s and not (regexp_replace(text, '[。.!！?？{SPACE}]', '', 'g') in ('LicensedunderCCBY-NC40', 'Allrightsreserved') and e - s >= 10)),
      b as (select * from {_islands("text", "k", "doc_id", "pos")} where run < 4)
      select doc_id, row_number() over (partition by doc_id order by pos) as idx, {_stamp("s")} || ' --> ' || {_stamp("e")} as timing, text from b""",
    "video_gate": f"""with {_TRACKS}, a as (select media_id, bool_and({_FITS}) as aligned from {_PAIRS} group by media_id),
      c as (select media_id, idx, {_SQUASH("text")} as c from s), r as (select * from {_runs("c", "media_id, idx", "c")}),
      v as (select media_id, bool_and(c <> '' and coalesce(run, 1) < 12 and not regexp_matches(c, '[0-9]{{2,}}') and length(c) <= 120) as sound from c left join r using (media_id, idx) group by media_id)
      select media_id, coalesce(aligned, false) and coalesce(sound, false) and media_id % 5 <> 0 as open from a left join v using (media_id)""",
    "pair_alignment": f"with {_TRACKS} select media_id, count(*) as pairs, bool_and({_FITS}) as aligned from {_PAIRS} group by media_id",
    "stacked_pairs": f"""with {_TRACKS}, g as (select media_id from {_PAIRS} group by media_id having bool_and({_FITS}))
      select media_id, idx, s.timing as timing, {_STRIP("t.text")} || chr(10) || {_STRIP("s.text")} as text from {_PAIRS} where media_id in (from g)""",
    "validation_report": """with c as (select o_orderkey as media_id, l_linenumber as idx, datediff('day', o_orderdate, l_shipdate) * 1000 as a,
          (datediff('day', o_orderdate, l_shipdate) * 1000 + l_quantity * 100)::bigint as b, l_returnflag || l_linestatus as text, l_partkey, l_suppkey, l_extendedprice
          from lineitem join orders on l_orderkey = o_orderkey),
      u as (select *, 'ja' as lang from c union all select *, 'zh-Hans' from c where text <> 'AF'),
      n as (select *, row_number() over w as pos, coalesce(lag(a) over w, -1) as before from u window w as (partition by media_id, lang order by idx, a, l_partkey, l_suppkey, l_extendedprice, b)),
      f as (select media_id, lang, count(*) as cues, min_by(m, pos) filter (m is not null) as failure from (select *, case
          when idx <> pos then 'cue index ' || idx || ', expected ' || pos when a < before or b <= a or b > 102000 then 'invalid cue timing at ' || idx
          when lang = 'zh-Hans' and text like '%R%' then 'Japanese script remains at cue ' || idx end as m from n) group by all),
      l as (select o_orderkey as media_id, 'm' || o_orderkey as name, lang, tier, stage from orders, (values ('ja', 0, 'transcription'), ('zh-Hans', 1, 'translation')) v(lang, tier, stage)),
      r as (select l.*, cues, case when cues is null then 'missing' when media_id % 11 = 0 and lang = 'ja' then 'malformed block' when lang = 'ja' and cues >= 7 then 'too many cues'
          when media_id % 7 = 1 then 'missing or malformed ' || stage || ' provenance' when media_id % 7 = 0 then 'stale ' || stage || ' provenance' else failure end as m from l left join f using (media_id, lang)),
      p as (select media_id, name from r where m is null group by all having count(*) = 2),
      al as (select media_id, bool_and(coalesce(s.idx = t.idx and s.a = t.a and s.b = t.b, false)) as ok from (from n where lang = 'ja') s full outer join (from n where lang = 'zh-Hans') t using (media_id, pos) group by media_id)
      select media_id, tier::bigint as tier, case when m is null then 'PASS' else 'FAIL' end as status, name || '.' || lang || '.srt' as name, coalesce(m, cues || ' cues') as detail from r
      union all select media_id, 2, case when ok then 'PASS' else 'FAIL' end, name, case when ok then 'Japanese/Chinese cues aligned' else 'Japanese/Chinese cue count, index, or timing mismatch' end from p join al using (media_id)""",
    "srt_roundtrip": f"""with e as (select event_id, event_type, {_SECONDS} as s, {_SECONDS} + value / 7 as e from events)
      select event_id, event_id as idx, {_stamp("s")} || ' --> ' || {_stamp("e")} as timing, greatest(0, round_even(s * 1000, 0)::bigint) as start_ms,
        greatest(0, round_even(e * 1000, 0)::bigint) as end_ms, event_type as text from e""",
    "fingerprints": """with d as (select doc_id, sha256(concat_ws('|', 'translation', doc_id, lang, source, sha256(text))) as fingerprint from documents)
      select doc_id, fingerprint, case when doc_id % 5 = 0 then 'missing' when doc_id % 3 = 0 then 'stale' else 'current' end as provenance from d""",
    "pending_work": """select doc_id, sha256(doc_id || '|' || n_chars) as fingerprint from documents where doc_id % 4 = 1 or doc_id % 6 = 0""",
    "review_reasons": f"""with {_TRACKS} select media_id, idx as pos, array_to_string({_REASONS}, ', ') as reasons,
        {_STRIP("t.text")} <> '' and {_STRIP("t.text")} <> {_STRIP("s.text")} and not regexp_matches({_STRIP("t.text")}, '{_LEFT}')
        and not ((regexp_matches(s.text, '{_LEFT}') or regexp_matches(s.text, '{_IDEO}')) and not regexp_matches({_STRIP("t.text")}, '{_IDEO}')) as safe
      from s join t using (media_id, idx)""",
    "marker_parse": rf"""with c as (select conv_id, turn, '[' || (case when turn % 3 = 2 then turn else turn + 1 end) || '] ' || text as t from conversations),
      r as (select conv_id, coalesce(chr(10) || string_agg(t, chr(10) order by turn, t), '') as r from c group by conv_id),
      m as (select conv_id, string_split(regexp_replace(r, '\n[{SPACE}]*\[([0-9]+)\][{SPACE}]*', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:] as l from r),
      x as (select conv_id, unnest(l) as x, generate_subscripts(l, 1) as pos from m),
      i as (select conv_id, pos, try_cast(split_part(x, chr(2), 1) as int) as n, {_STRIP("substr(x, strpos(x, chr(2)) + 1)")} as t from x),
      k as (select conv_id, n, arg_max(t, pos) as t from i where n between 1 and 2 and t <> '' group by conv_id, n)
      select conv_id, case when count(k.n) = 2 then string_agg(k.t, '¦' order by k.n) end as items from r left join k using (conv_id) group by conv_id""",
    "media_names": r"select c_name || '.MKV' as name, lower(c_name || '.MKV') as key, c_name as stem from customer",
    "inventory_rollup": """select count(*) as videos, sum(n_chars)::bigint as bytes, count(*) filter (q) as source_complete, count(*) filter (x) as target_complete
      from documents left join (select doc_id, bool_or(quality = 1) as q, bool_or(toxic = 1) as x from labels group by doc_id) using (doc_id)""",
    "status_action": """with f as (select source, count(*) as v, count(*) filter (quality = 1) as t, count(*) filter (toxic = 1) as q, min(doc_id) % 7 as k from documents left join labels using (doc_id) group by source)
      select source, case when k = 0 then 'unreadable' end as x, case when k = 0 then 'resolve_failure' when k = 2 then 'bootstrap' when k = 1 then 'monitor'
        when q % 2 <> 1 and q % 3 <> 1 then case when k = 3 then 'review_full_video' when k = 4 then 'review_sample' else 'run_sample' end
        when q % 3 <> 1 then case when t > 10 then 'review_full_video' else 'process_first_video' end when t < v then 'resume' else 'validate' end as action from f""".replace("case when k = 0 then 'unreadable' end as x, ", ""),
    "gate_current": """select doc_id as media, quality = 1 and (toxic <> 1 or lang = 'en') and doc_id % 9 <> 0 as current from labels join documents using (doc_id)""",
    "event_log_stream": """with e as (select event_id, epoch_us(ts) as us from events), w as (select *, unnest([0, 1]) as k from e), s as (select *, (us // 3000000000 - k) * 3000000000 as a from w)
      select event_id, a // 1000000 as window_start from s where us >= a + 300000000 and us < a + 3300000000""",
    "chunk_stream": "select doc_id as media_id, 0::bigint as chunk_no, length(text)::bigint as chars from documents",
    "carried_context": """select conv_id, turn, coalesce(array_to_string(list(text) over (partition by conv_id order by turn rows between 2 preceding and 1 preceding), '¦'), '') as context from conversations""",
}
TWINS["report_lines"] = f"select media_id, tier, concat_ws(chr(9), status, name, detail) as line from ({TWINS['validation_report']})"
