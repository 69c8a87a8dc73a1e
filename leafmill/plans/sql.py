"""The SQL that the queries are held against, in DuckDB's dialect."""

from __future__ import annotations

from ..functions.text import MARKDOWN

# The browser's white space and the characters that can't be seen, as character classes.
SPACE = r"[\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
INVISIBLE = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]"


def _normal(expr: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({expr}, ''), '{INVISIBLE}', '', 'g'), '{SPACE}+', ' ', 'g'))"


def _decoded(expr: str) -> str:
    out = expr
    for name, mark in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("#39", "''"), ("nbsp", " "), ("amp", "&")):
        out = f"regexp_replace({out}, '&{name};?', '{mark}', 'g')"
    return out


_TITLE = _decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")

_BLOCKS = rf"""
a as (select page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as h from pages),
s as (select page_id, url, unnest(range(1, len(p) + 1)) as nr, unnest(p) as piece
      from (select page_id, url, regexp_extract_all(h, '(?s)<(?:p|h1)>(?:[^<]|<b>|</b>|<br>)*') as p from a)),
t as (select page_id, url, nr, case when piece like '<h1>%' then 'heading' else 'paragraph' end as type,
             case when piece like '<h1>%' then 1 end as level, {_normal(_decoded("regexp_replace(piece, '<[^>]+>', '', 'g')"))} as text
      from s),
f as (select * from t where text <> '' qualify row_number() over (partition by page_id, type, text order by nr) = 1),
-- an article that scores less is no content area
d as (select * from f qualify sum(length(text) + 20) over (partition by page_id) > 120),
b as (select page_id, url, row_number() over (partition by page_id order by nr) as pos, type, level, text from d)
"""

_MARKDOWN = f"""
m as (select page_id, url, string_agg(case when type = 'heading' then '# ' || text else text end, chr(10) || chr(10) order by pos) as body from b group by page_id, url),
r as (select page_id, '# ' || coalesce(nullif({_normal(_TITLE)}, ''), 'Web Clip') || chr(10) || chr(10) || 'Source: ' || {_normal("p.url")} || chr(10)
             || 'Captured: 2024-05-06 07:08' || chr(10) || chr(10) || body || chr(10) as markdown
      from m join pages p using (page_id))
"""


def _name(expr: str, most: int, title: bool) -> str:
    out = f"regexp_replace(coalesce({expr}, ''), '{INVISIBLE.replace('[', '[', 1)}', '', 'g')"
    if title:
        out = rf"regexp_replace(coalesce({expr}, ''), '[\x{{00}}-\x{{1f}}\x{{7f}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{206f}}\x{{feff}}]+', ' ', 'g')"
        out = rf"regexp_replace({out}, '[\\/:*?\x22<>|]+', '-', 'g')"
        out = f"trim(regexp_replace({out}, '{SPACE}+', ' ', 'g'))"
        tail = r"[-. ]+$"
    else:
        out = f"trim(regexp_replace({out}, '{SPACE}+', ' ', 'g'))"
        out = rf"regexp_replace({out}, '[\\/:*?\x22<>|]+', '-', 'g')"
        tail = "-+$"
    out = f"regexp_replace(regexp_replace({out}, '-+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"coalesce(nullif(regexp_replace(left({out}, {most}), '{tail}', ''), ''), 'web-clip')"


_NAME = _name(_TITLE, 80, True)
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n]+'), lambda w: w <> '')"
_ENTRIES = "e as (select source || '-' || (doc_id // 1000)::varchar as archive_id, doc_id as seq, source || '/' || doc_id || '.md' as path, coalesce(text, '') as data from documents)"
_OFFSETS = f"""with {_ENTRIES}
select archive_id, seq, strlen(data) as size,
       coalesce(sum(30 + strlen(path) + strlen(data)) over w, 0)::bigint as local_offset, coalesce(sum(46 + strlen(path)) over w, 0)::bigint as central_offset
from e window w as (partition by archive_id order by seq rows between unbounded preceding and 1 preceding)"""

_HOST = """case event_id % 7 when 0 then (event_id % 256) || '.' || (user_id % 256) || '.1.2' when 1 then '192.' || (user_id % 256) || '.0.9'
  when 2 then 'h' || user_id || '.local' when 3 then 'localhost' when 4 then 'u:p@h' || user_id || '.example.com' else 'h' || user_id || '.example.com' end"""

_LINES = f"""l as (select doc_id as page_id, unnest(range(len(x))) as i, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
n as (select page_id, i, i % 4 as k, {_normal("line")} as md, {_normal("regexp_replace(line, '[*~]+', '', 'g')")} as text from l)"""

_CODE = f"regexp_replace(regexp_replace(line, '{INVISIBLE}', '', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')"
_RICH = f"""l as (select doc_id as page_id, unnest(range(len(x))) as i, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
k as (select page_id, i, i % 8 as k, line, {_normal("line")} as t, 'https://www.example.com/docs/page?n=' || (i + 1) as link from l),
f as (select page_id, i, ['heading', 'paragraph', 'listItem', 'quote', 'code', 'image', 'video', 'link'][k + 1] as type, case when k = 0 then 3 end as level,
  case k when 4 then {_CODE} when 5 then null when 6 then 'Clip ' || (i + 1) when 7 then coalesce(nullif(t, ''), link) else t end as text,
  case k when 5 then 'https://www.example.com/i/' || (i + 1) || '.png' when 6 then 'https://www.example.com/docs/v/' || (i + 1) || '.mp4' end as src, case when k = 5 then t end as alt, case when k = 7 then link end as href from k),
g as (select * from f where src is not null or text <> '' qualify row_number() over (partition by page_id, type, level, text, src, alt, href order by i) = 1),
r as (select *, row_number() over (partition by page_id order by i) as pos from (select * from g qualify sum(length(coalesce(nullif(text, ''), alt)) + 20 + case when type in ('image', 'video') then 30 else 0 end) over (partition by page_id) > 120))"""


def _label(expr: str) -> str:
    return rf"regexp_replace({expr}, '([\\\[\]])', '\\\1', 'g')"


ORACLES = {
    "doc_plain_lists": """with l as (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') as x from documents)
select doc_id, md5(array_to_string(list_transform(x, lambda y: '- ' || rtrim(replace(replace(ltrim(y), chr(160), ' '), '****', ''))), chr(10))) as list_md5, len(x)::int as n_lines from l""",
    "feishu_page_blocks": f"""with {_LINES}, r as (select *, ['paragraph', 'listItem', 'heading', 'listItem'][k + 1] as type from n where md <> '' and (k <> 2 or text <> ''))
select page_id, row_number() over (partition by page_id order by i) as pos, type, case when k = 2 then 2 end as level, text, case when k <> 2 then md end as markdown,
       case when k in (1, 3) then k = 3 end as ordered, case when k in (1, 3) then 0 end as depth, 'feishu-block:' || (i + 1) as source_id from r""",
    "course_page_blocks": f"""with {_LINES}, r as (select page_id, i, k, ['paragraph', 'listItem', 'heading', 'quote'][k + 1] as type, case when k = 2 then md else text end as text, case when k <> 2 then md end as markdown from n where md <> '' and text <> ''),
d as (select * from r qualify row_number() over (partition by page_id, type, text, markdown order by i) = 1)
select page_id, row_number() over (partition by page_id order by i) as pos, type, case when k = 2 then 3 end as level, text, markdown, case when k = 1 then false end as ordered, case when k = 1 then 0 end as depth from d""",
    "page_blocks": f"with {_BLOCKS} select page_id, pos, type, level, text from b",
    "page_scores": f"with {_BLOCKS} select page_id, (sum(length(text)) + 20 * count(*))::bigint as score, count(*) as n_blocks from b group by page_id",
    "page_type_counts": f"with {_BLOCKS} select type, count(*) as n_blocks, count(distinct page_id) as n_pages from b group by type",
    "page_markdown": f"with {_BLOCKS}, {_MARKDOWN} select * from r",
    "page_export_names": f"""with n as (select page_id, {_NAME} as safe_title from pages)
select page_id, safe_title, '20240506-0708' as timestamp, safe_title || '__20240506-0708' as base_name, safe_title || '__20240506-0708.zip' as zip_name,
       safe_title || '__20240506-0708' as folder_name, safe_title || '.md' as markdown_name, safe_title || '.assets' as assets_dir from n""",
    "page_links": rf"""with l as (select page_id, url, unnest(range(1, len(x) + 1)) as n, unnest(x) as tag from (select page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as x from pages))
select page_id, n, {_normal(_decoded("regexp_extract(tag, '>([^<]*)<', 1)"))} as text,
       regexp_extract(url, '^[a-z]+://[^/]*') || regexp_replace(regexp_replace(regexp_replace(url_encode(regexp_extract(tag, 'href="([^"?#]*)', 1)), '%2F', '/', 'g'), '%2C', ',', 'g'), '%2[1]', '!', 'g') as href from l""",
    "site_family_dispatch": """with v as (
  select page_id, host, case when host = '' then url else 'https://' || host || case page_id % 3 when 0 then '/articleDetail/xq_topic/' || page_id when 1 then '/course/detail/' || page_id else '/x' end end as url
  from pages, unnest(['mp.weixin.qq.com', 'www.scys.com', 'a.feishu.cn', 'FEISHU.CN.', 'xfeishu.cn', '']) as h(host)),
f as (select page_id, host, case when host = 'mp.weixin.qq.com' then 'wechat' when host = 'www.scys.com' and page_id % 3 = 0 then 'scys-article' when host = 'www.scys.com' and page_id % 3 = 1 then 'scys'
  when host in ('a.feishu.cn', 'FEISHU.CN.') then 'feishu' else 'generic' end as adapter from v)
select page_id, host, adapter, merge_mode, stable_rounds, wait_ms from f join (values ('wechat', 'latest', 2, 700), ('scys-article', 'latest', 4, 1000), ('scys', 'ordered', 10, 1000), ('feishu', 'accumulate', 4, 900),
  ('generic', 'ordered', 4, 900)) as p(adapter, merge_mode, stable_rounds, wait_ms) using (adapter)""",
    "media_url_safety": f"""with h as (select event_id, event_id % 11 = 0 as ftp, event_id % 7 as k, {_HOST} as host, 'h' || (event_id % 50) || '.example.com' as page, event_id % 256 as a, user_id % 256 as b from events),
v as (select event_id, host, page, case when ftp then 'unsupported protocol' when k = 4 then 'embedded credentials'
  when k in (2, 3) or (k = 0 and (a in (0, 10, 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168))) or (k = 1 and b = 168) then 'local or private destination' end as why from h)
select event_id, why is null as ok, 'unsafe image URL: ' || why as reason, case when why is not null then null when host = page then 'include' else 'omit' end as credentials from v""",
    "log_safe_url": "select page_id, regexp_replace(url, '[?#].*$', '') as safe, 'invalid-url' as bare from pages",
    "doc_normalized": f"select doc_id, md5({_normal('text')}) as text_md5, length({_normal('text')}) as units from documents",
    "doc_lines_dedupe": f"""with l as (select doc_id, unnest(range(len(x))) as pos, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
n as (select doc_id, min(pos) as pos, line from (select doc_id, pos, {_normal('line')} as line from l) where line <> '' group by doc_id, line)
select doc_id, count(*) as n_lines, md5(string_agg(line, chr(10) order by pos)) as lines_md5 from n group by doc_id""",
    "doc_filename": f"select doc_id, {_name('text', 120, False)} as file_name, {_name('text', 80, True)} as title_name from documents",
    "line_overlap_merge": f"""with p as (select doc_id, left(text, (length(text) // 2 + doc_id % 31)::bigint) as l0, substr(text, length(text) // 2 + 1) as r0 from documents),
q as (select doc_id, {_normal('l0')} as l, {_normal('r0')} as r from p),
s as (select doc_id, l, r, list_max(list_filter(range(12, least(length(l), length(r)) + 1), lambda k: right(l, k) = left(r, k))) as k from q)
select doc_id, case when k is not null then l || substr(r, k + 1) end as merged from s""",
    "list_islands": f"""with l as (select page_id, unnest(range(1, len(x) + 1)) as n, unnest(x) as tag from (select page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as x from pages)),
i as (select page_id, n, {_normal(_decoded("regexp_extract(tag, '>([^<]*)<', 1)"))} as text from l),
a as (select page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as h from pages),
s as (select page_id, unnest(regexp_extract_all(h, '(?s)<(?:p|h1)>(?:[^<]|<b>|</b>|<br>)*')) as piece from a),
o as (select page_id, case when piece like '<h1>%' then 'heading' else 'paragraph' end as type from s where {_normal(_decoded("regexp_replace(piece, '<[^>]+>', '', 'g')"))} <> ''),
r as (select page_id, 'paragraph' as type, count(*) as n_items, string_agg('- ' || text, chr(10) order by n) as list_text from i where text <> '' group by page_id),
u as (select page_id, type, 1 as n_items, null as list_text from o union all select page_id, type, n_items, list_text from r)
select page_id, type, count(*) as n_blocks, max(n_items)::int as most_items, max(list_text) as list_text from u group by page_id, type""",
    "table_render": rf"""with w as (select doc_id, {_WORDS} as w, (doc_id % 4 + 1)::int as k from documents),
x as (select doc_id, k, len(w) as n, list_transform(w, lambda v: replace(v, '|', '\|') || '\|') as w from w),
g as (select doc_id, k, list_transform(range(0, greatest(ceil(n / k)::int, 1)), lambda r: list_resize(w[r * k + 1 : r * k + k], 5, '')) as rows, n from x),
h as (select doc_id, n, rows, rows[1][1:4] || ['![a\[b\]](i%20%28' || doc_id || '%29.png)'] as head from g)
select doc_id, case when n = 0 then '' else array_to_string(list_concat(['| ' || array_to_string(head, ' | ') || ' |', '| --- | --- | --- | --- | --- |'], list_transform(rows[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |')), chr(10)) end as markdown from h""",
    "cell_chunking": f"""with c as (select doc_id, unnest(range(len(w))) as nr, unnest(w) as word from (select doc_id, {_WORDS} as w from documents)),
r as (select doc_id, nr // 3 as row, max(case when nr % 3 = 0 then word end) as c0, coalesce(max(case when nr % 3 = 1 then word end), '') as c1, coalesce(max(case when nr % 3 = 2 then word end), '') as c2 from c group by doc_id, nr // 3)
select doc_id, count(*) as n_rows, count(*) filter (c2 = '') as n_short, max_by(c0 || ' ' || c1 || ' ' || c2, row) as last_row from r group by doc_id""",
    "image_signature": "select doc_id, case doc_id % 7 when 0 then 'jpeg' when 1 then 'png' when 2 then 'gif' when 3 then 'webp' when 4 then 'avif' when 5 then case when strlen(text) >= 4 then 'mp4' else 'none' end else 'none' end as kind from documents",
    "fifo_media_rewrite": """with u as (select user_id as page_id, event_id, event_type as src, row_number() over (partition by user_id, event_type order by event_id) as nth from events),
r as (select user_id as page_id, event_type as src, event_id % 3 <> 0 as ok, 'image-' || case when event_id + 1 < 1000 then lpad((event_id + 1)::varchar, 3, '0') else (event_id + 1)::varchar end || '.png' as file_name,
  row_number() over (partition by user_id, event_type order by event_id) as nth from events where event_type <> 'error')
select page_id, event_id, case when ok then './a.assets/' || file_name else src end as src from u left join r using (page_id, src, nth)""",
    "zip_offsets": _OFFSETS,
    "zip_path_safety": r"""with p as (select doc_id, case doc_id % 8 when 0 then source || '/' || doc_id when 1 then '/' || source || '/' || doc_id when 2 then source || '//' || doc_id when 3 then '../' || source || '/' || doc_id
  when 4 then 'C:' || source || '/' || doc_id when 5 then source || '\' || doc_id when 6 then source || '/./' || doc_id else source || '/' || doc_id || '/' end as path from documents)
select doc_id, path, not (path like '/%' or regexp_matches(path, '^[A-Za-z]:') or contains(path, '\') or list_has_any(string_split(path, '/'), ['', '..'])) as safe from p""",
    "coverage_diagnostics": f"""with {_BLOCKS},
c as (select page_id, sum(length(text))::bigint as source_chars from t group by page_id),
x as (select page_id, sum(length(text))::bigint as exported_chars from b group by page_id),
y as (select page_id, source_chars, coalesce(exported_chars, 0) as exported_chars, 0 as images from c left join x using (page_id)),
z as (select *, case when source_chars = 0 then 100 else round(100 * exported_chars / source_chars) end::bigint as percent from y)
select *, source_chars >= 80 and percent < 70 as warn from z""",
    "log_lines": r"select event_id, '[extract] event\n' || event_type || ' user=' || user_id || ' tab\tkey=' || event_type as line from events",
    "collector_stream": """with e as (select user_id as page_id, event_id, event_type || ' ' || hour(ts) as block from events),
n as (select page_id, row_number() over w as r, row_number() over (partition by page_id, block order by event_id) = 1 as fresh from e window w as (partition by page_id order by event_id)),
q as (select *, sum(fresh::int) over (partition by page_id order by r rows between 3 preceding and current row) as lately from n),
z as (select page_id, min(case when r > 4 and lately = 0 then r end) as stop from q group by page_id),
k as (select q.page_id, stop, r, fresh from q join z using (page_id) where stop is null or r <= stop)
select page_id, max(r)::int as rounds, count(*) filter (fresh)::int as n_blocks, (max(r) - max(case when fresh then r end))::int as idle, case when max(stop) is null then 'running' else 'idle' end as status from k group by page_id""",
}
ORACLES |= {
    "article_page_blocks": f"""with {_LINES}, r as (select page_id, i, k, ['paragraph', 'listItem', 'heading', 'quote'][k + 1] as type, text, case when k <> 2 then md end as markdown from n where md <> '' and text <> ''),
d as (select * from r qualify row_number() over (partition by page_id, type, text, markdown order by i) = 1),
-- list items that are neighbours once repeated blocks are gone are one paragraph
e as (select *, row_number() over (partition by page_id order by i) - row_number() over (partition by page_id, type order by i) as run from d),
g as (select *, type = 'listItem' and count(*) over (partition by page_id, type, run) > 1 as many from e),
j as (select page_id, i, type, case when k = 2 then 3 end as level, text, markdown, case when k = 1 then false end as ordered, case when k = 1 then 0 end as depth from g where not many union all
  select page_id, min(i), 'paragraph', null, string_agg('- ' || text, ' ' order by i), string_agg('- ' || markdown, chr(10) order by i), null, null from g where many group by page_id, run)
select page_id, row_number() over (partition by page_id order by i) as pos, type, level, text, markdown, ordered, depth from j""",
    "wechat_page_blocks": rf"""with l as (select doc_id as page_id, unnest(range(len(x))) as i, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
n as (select page_id, i, i % 4 as k, {_normal("line")} as t, regexp_replace({_normal("line")}, '([\\*_`\[\]])', '\\\1', 'g') as e, sum((i % 4 = 3)::int) over (partition by page_id order by i) as cut from l),
m as (select page_id, cut, min(i) as i, string_agg(case when k = 1 then '## ' || e else e end, chr(10) || chr(10) order by i) as md from n where k < 3 and t <> '' group by page_id, cut),
u as (select page_id, i, 'paragraph' as type, md, null as src, null as alt from m union all
  select page_id, i, 'image', null, 'https://mmbiz.qpic.cn/' || (i + 1) || '?wx_fmt=png&tp=webp', t from n where k = 3)
select page_id, row_number() over (partition by page_id order by i) as pos, type, md5(md) as markdown_md5, src, alt,
       case when type = 'image' then 'wechat:image:' || regexp_replace(src, '&tp=webp$', '') else 'wechat:text:' || row_number() over (partition by page_id, type order by i) end as source_id from u""",
    "rich_page_blocks": f"with {_RICH} select page_id, pos, type, level, text, src, alt, href from r",
    "rich_page_markdown": f"""with {_RICH},
c as (select *, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0))) as fence from r),
m as (select page_id, pos, case type when 'heading' then '### ' || text when 'listItem' then '- ' || text when 'quote' then '> ' || text when 'code' then fence || chr(10) || text || chr(10) || fence
  when 'image' then '![' || {_label("alt")} || '](' || src || ')' when 'video' then '[' || text || '](' || src || ')' when 'link' then '[' || {_label("text")} || '](' || href || ')' else text end as md from c),
w as (select page_id, '# Rich page' || chr(10) || chr(10) || 'Source: https://www.example.com/docs/page' || chr(10) || 'Captured: 2024-05-06 07:08' || chr(10) || chr(10) || string_agg(md, chr(10) || chr(10) order by pos) || chr(10) as t from m group by page_id)
select page_id, md5(t) as markdown_md5, length(t)::int as n_chars from w""",
    "media_localized": """with u as (select doc_id as page_id, doc_id as n, coalesce(text, '') as text, unnest(['image', 'image', 'image', 'image', 'image', 'video']) as kind, unnest([0, 1, 2, 3, 4, 0]) as idx,
  unnest(['/m/' || doc_id || '.png', 'http://10.0.0.1/x.png', 'ftp://e.com/a.png', '/m/' || doc_id || '.gif', 'm/' || doc_id || '.png?again', '/m/' || doc_id || '.mp4']) as src from documents),
v as (select *, case when kind = 'image' and idx = 1 then 'unsafe image URL: local or private destination' when kind = 'image' and idx = 2 then 'unsafe image URL: unsupported protocol' when kind = 'image' and idx = 4 then 'not found'
  when n % 5 = 0 then 'status=404' when kind = 'image' and idx = 3 and n % 4 = 0 then 'unexpected content-type=text/html' when kind = 'image' and idx = 3 and n % 3 = 0 then 'image signature mismatch expected=gif'
  when kind = 'video' and n % 7 = 0 then 'video signature mismatch expected=mp4' end as reason,
  case when kind = 'video' then '00000018667479706D703432' when idx = 3 then '474946383961' else '89504E470D0A1A0A' end as start from u)
select page_id, kind, idx::int as idx, src, reason is null as ok, reason, case when reason is null then case when kind = 'video' then 'video-001.mp4' when idx = 3 then 'image-004.gif' else 'image-001.png' end end as file_name,
       case when reason is null then md5(unhex(start) || encode(text)) end as data_md5 from v""",
}
ORACLES |= {"line_overlap_merge_whole": ORACLES["line_overlap_merge"], "table_render_whole": ORACLES["table_render"]}


# ---- pages of all families in one table


def _of_site(name: str, k: int) -> str:
    """The SQL of a query over the documents that are pages of one site."""
    return ORACLES[name].replace("from documents)", f"from documents where doc_id % 6 = {k})")


def _site_lines(k: int, forms: int) -> str:
    return f"""l as (select doc_id as page_id, unnest(range(len(x))) as i, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents where doc_id % 6 = {k})),
n as (select page_id, i, i + 1 as n, i % {forms} as k, {_normal("line")} as md, {_normal("regexp_replace(line, '[*~]+', '', 'g')")} as text, {_normal("'in ' || line")} as md_in, {_normal("'in ' || regexp_replace(line, '[*~]+', '', 'g')")} as text_in,
  rtrim('  ' || regexp_replace(line, '{INVISIBLE}', '', 'g'), ' ' || chr(9)) as code from l)"""


# of the items of the course family: a paragraph, list items, a heading, a quote, code, a grid, nested list items
_ITEM_ROWS = """select page_id, n, 0 as part, ['paragraph', 'listItem', 'heading', 'quote'][k + 1] as type, case when k = 2 then 3 end as level, case when k = 2 then md else text end as text, case when k <> 2 then md end as markdown,
  case when k = 1 then false end as ordered, case when k = 1 then 0 end as depth, null as language, null as src, null as alt, null as rows from n where k < 4 and text <> ''
union all select page_id, n, 0, case when code = '' then 'paragraph' else 'code' end, null, case when code = '' then 'Plain Text' else code end, case when code = '' then 'Plain Text' end, null, null, case when code <> '' then 'text' end, null, null, null from n where k = 4
union all select page_id, n, 0, 'table', null, null, null, null, null, null, null, null, to_json([[md, 'n ' || n], ['x', '']])::varchar from n where k = 5
union all select page_id, n, 0, 'listItem', null, text, md, false, 0, null, null, null, null from n where k = 6 and text <> ''
union all select page_id, n, 1, 'listItem', null, text_in, md_in, false, 1, null, null, null, null from n where k = 6"""
_SITE_COLUMNS = "page_id, family, pos, type, level, text, markdown, ordered, depth, language, src, alt, href, rows, source_id"

_SITE_FEISHU = f"""with {_site_lines(3, 8)},
r as (select *, ['paragraph', 'listItem', 'heading', 'listItem', 'code', 'image', 'table', 'quote'][k + 1] as type from n where k in (5, 6) or (md <> '' and (k <> 2 or text <> '')))
select page_id, 'feishu' as family, row_number() over (partition by page_id order by n) as pos, type, case when k = 2 then 2 end as level, case when k = 4 then md when k in (5, 6) then null else text end as text,
  case when k in (0, 1, 3, 7) then md end as markdown, case when k in (1, 3) then k = 3 end as ordered, case when k in (1, 3) then 0 end as depth, null as language,
  case when k = 5 then 'https://a.feishu.cn/i/' || n || '.png' end as src, case when k = 5 then md end as alt, null as href, case when k = 6 then to_json([[md, 'n ' || n]])::varchar end as rows,
  case k when 5 then 'feishu-image:' when 7 then 'feishu-block:q' else 'feishu-block:' end || n as source_id from r"""

_SITE_COURSE = f"""with {_site_lines(2, 8)},
r as ({_ITEM_ROWS} union all select page_id, n, 0, 'video', null, coalesce(nullif(md, ''), 'Video'), null, null, null, null, 'https://v.example.com/' || n || '.mp4', null, null from n where k = 7),
d as (select * from r qualify row_number() over (partition by page_id, type, level, text, markdown, ordered, depth, src, rows order by n, part) = 1)
select page_id, 'scys' as family, row_number() over (partition by page_id order by n, part) as pos, type, level, text, markdown, ordered, depth, language, src, alt, null as href, rows,
  case type when 'table' then 'scys:' || n || ':table' when 'video' then 'scys:' || n || ':video:0' end as source_id from d"""

_SITE_ARTICLE = f"""with {_site_lines(1, 8)},
r as ({_ITEM_ROWS.replace("case when k = 2 then md else text end as text", "text")} union all select page_id, n, 0, 'paragraph', null, text, md, null, null, null, null, null, null from n where k = 7 and text <> ''
  union all select page_id, n, 1, 'image', null, null, null, null, null, null, 'https://scys.com/i/' || n || '.png', md, null from n where k = 7),
d as (select * from r qualify row_number() over (partition by page_id, type, level, text, markdown, ordered, depth, src, rows order by n, part) = 1),
e as (select *, row_number() over (partition by page_id order by n, part) - row_number() over (partition by page_id, type order by n, part) as run from d),
g as (select *, type = 'listItem' and count(*) over (partition by page_id, type, run) > 1 as many from e),
j as (select page_id, n, part, type, level, text, markdown, ordered, depth, language, src, alt, rows from g where not many union all
  select page_id, min(n), min(part), 'paragraph', null, string_agg('- ' || text, ' ' order by n, part), string_agg(repeat('    ', depth) || '- ' || markdown, chr(10) order by n, part), null, null, null, null, null, null from g where many group by page_id, run)
select page_id, 'scys-article' as family, row_number() over (partition by page_id order by n, part) as pos, type, level, text, markdown, ordered, depth, language, src, alt, null as href, rows, null as source_id from j"""

_SITE_GENERIC = "select page_id, 'generic' as family, pos, type, level, text, null as markdown, null::boolean as ordered, null::int as depth, null as language, src, alt, href, null as rows, null as source_id"
_SITE_WECHAT = rf"""with l as (select doc_id as page_id, unnest(range(len(x))) as i, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents where doc_id % 6 = 0)),
n as (select page_id, i, i % 4 as k, {_normal("line")} as t, regexp_replace({_normal("line")}, '([\\*_`\[\]])', '\\\1', 'g') as e, sum((i % 4 = 3)::int) over (partition by page_id order by i) as cut from l),
m as (select page_id, cut, min(i) as i, string_agg(case when k = 1 then '## ' || e else e end, chr(10) || chr(10) order by i) as md from n where k < 3 and t <> '' group by page_id, cut),
u as (select page_id, i, 'paragraph' as type, md, null as src, null as alt from m union all
  select page_id, i, 'image', null, 'https://mmbiz.qpic.cn/' || (i + 1) || '?wx_fmt=png&tp=webp', t from n where k = 3)
select page_id, 'wechat' as family, row_number() over (partition by page_id order by i) as pos, type, null::int as level, null as text, md as markdown, null::boolean as ordered, null::int as depth, null as language, src, alt, null as href, null as rows,
       case when type = 'image' then 'wechat:image:' || regexp_replace(src, '&tp=webp$', '') else 'wechat:text:' || row_number() over (partition by page_id, type order by i) end as source_id from u"""

ORACLES |= {
    "mixed_site_blocks": " union all ".join(
        f"select {_SITE_COLUMNS} from ({part})"
        for part in (
            _SITE_WECHAT, _SITE_ARTICLE, _SITE_COURSE, _SITE_FEISHU, f"{_SITE_GENERIC} from ({_of_site('rich_page_blocks', 4)})",
            f"{_SITE_GENERIC} from ({_of_site('rich_page_blocks', 5).replace('https://www.example.com/docs/page', 'https://scys.com/course/detail/1').replace('https://www.example.com/docs/', 'https://scys.com/course/detail/').replace('https://www.example.com/', 'https://scys.com/')})",
        )
    ),
    "mixed_site_titles": """select doc_id as page_id, ['wechat', 'scys-article', 'scys', 'feishu', 'generic', 'generic'][doc_id % 6 + 1] as family,
  ['Account page', 'A topic', 'Course', 'Doc & more', 'Rich page', 'Web Clip'][doc_id % 6 + 1] as title from documents""",
}
ORACLES["page_blocks_lateral"] = ORACLES["page_blocks"]

_BLOBS = """u as (select doc_id as page_id, doc_id as n, coalesce(text, '') as text, source, unnest(['image', 'image', 'image', 'image', 'image', 'video']) as kind, unnest([0, 1, 2, 3, 4, 0]) as idx from documents),
v as (select *, case when kind = 'video' then 'unsafe video URL: unsupported protocol' when idx in (2, 3) or (idx < 2 and n % 5 = 0) then 'unsafe image URL: unsupported protocol'
  when idx = 1 then 'image signature mismatch expected=jpeg' when idx = 4 and n % 4 = 0 then 'unsupported image type=image/bmp' end as reason, case idx when 4 then '474946383961' else '89504E470D0A1A0A' end as start from u)"""
ORACLES |= {
    "blob_images": f"""with {_BLOBS}
select page_id, kind, idx::int as idx, reason is null as ok, reason, case when reason is null then case idx when 4 then 'image-005.gif' else 'image-001.png' end end as file_name,
       case when reason is null then md5(unhex(start) || encode(case idx when 4 then source else text end)) end as data_md5 from v""",
    "media_metrics": f"with {_BLOBS} select kind, count(*) as total, count(*) filter (reason is null) as success, count(*) filter (reason is not null) as failed from v group by kind",
}

ORACLES |= {
    "promoted_areas": f"""with {_BLOCKS},
para as (select page_id, text as para from (select page_id, text, row_number() over (partition by page_id order by nr) as k from t where type = 'paragraph') where k = 2),
all_of as (select page_id, count(*) as all_blocks, string_agg(text, chr(10) order by nr) as whole, sum(length(text) + 20) > 120 as good from f group by page_id),
sel as (select page_id, page_id % 3 as k, coalesce(all_blocks, 0) as all_blocks, coalesce(whole, '') as whole, coalesce(good, false) as good, para, para is not null as has_para from pages left join all_of using (page_id) left join para using (page_id)),
chosen as (select *, case when k = 1 then all_blocks when k = 0 and has_para then (para <> '')::int end as n_selected, coalesce(k = 0 and has_para and good and all_blocks > (para <> '')::int + 2, false) as up from sel),
whole_area as (select *, k = 1 or n_selected is null or up as is_whole from chosen)
select page_id, n_selected::int as n_selected, case when n_selected is null and not (good and all_blocks > 0) then null else up end as promoted,
  case when n_selected is null and not (good and all_blocks > 0) then null when is_whole then all_blocks else (para <> '')::int end::int as n_blocks,
  case when n_selected is null and not (good and all_blocks > 0) then null else md5(case when is_whole then whole else para end) end as text_md5 from whole_area""",
    "ordered_log": f"select event_id, row_number() over (order by e.event_type, e.ts, event_id) as line_no, line from ({ORACLES["log_lines"]}) join events e using (event_id)",
}
ORACLES["event_details"] = """select event_id, '{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","none":null,"props":' || replace(props, ': ', ':') || ',"tags":["' || event_type || '",null],"user":' || user_id || ',"what":{"type":"' || event_type || '","value":' || value || '}}' as text,
  (props::json->>'k')::bigint as k, event_type as type, event_type as tag, null::int as odd from events"""


def _plain(expr: str) -> str:
    """Plain text of Markdown."""
    for pattern, with_ in MARKDOWN:
        expr = f"regexp_replace({expr}, '{pattern}', '{with_.replace('$', chr(92))}', 'g')"
    return _normal(expr)


_ALL_ACCOUNTS = _SITE_WECHAT[: _SITE_WECHAT.index("select page_id, 'wechat'")].replace("from documents where doc_id % 6 = 0)", "from documents)")
ORACLES["wechat_coverage"] = f"""{_ALL_ACCOUNTS},
src as (select page_id, coalesce(length(string_agg(t, ' ' order by i) filter (k < 3 and t <> '')), 0) as source_chars from n group by page_id),
out as (select page_id, sum(case when type <> 'image' then length({_plain("md")}) else 0 end)::bigint as exported_chars, count(*) filter (type = 'image') as images from u group by page_id),
both_ as (select page_id, source_chars, coalesce(exported_chars, 0) as exported_chars, coalesce(images, 0) as images from src left join out using (page_id))
select page_id, source_chars, exported_chars, images, 0 as code_blocks, 0 as tables, case when source_chars = 0 then 100 else round(100 * exported_chars / source_chars) end::bigint as percent,
       source_chars >= 80 and 100 * exported_chars < 70 * source_chars as warn from both_"""
