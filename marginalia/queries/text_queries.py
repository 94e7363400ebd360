"""Pages, titles, slugs, normalisers and other text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..session import table
from .registry import query

WS = r"[ \t\n\r\x0B\f]+"
SQUEEZE = "trim(regexp_replace({0}, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'))"
VISIBLE = SQUEEZE.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g')")
DASH = "regexp_replace(regexp_replace({0}, '{1}', '-', 'g'), '^-+|-+$', '', 'g')"
TITLE = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"


def pages(spark, folder):
    found = table(spark, folder, "pages")
    return found.withColumn("title", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))


@query(f"SELECT page_id, {VISIBLE} AS visible FROM pages")
def t19_visible_text(spark, folder):
    return pages(spark, folder).select("page_id", fn.visible_text(F.col("html")).alias("visible"))


@query(f"SELECT page_id, length({VISIBLE}) < 400 AS shell FROM pages")
def s12_needs_rendering(spark, folder):
    """Pages whose readable text is so short that a script must have been meant to fill them."""
    return pages(spark, folder).select("page_id", (F.length(fn.visible_text(F.col("html"))) < 400).alias("shell"))


@query(r"SELECT url, CASE WHEN regexp_matches(url, '(?i)(^|\.)blog\.|/blog\b|/posts?\b|/engineering\b|/research\b') THEN 'blog' ELSE 'article' END AS kind FROM pages")
def p09_kind_at_ingest(spark, folder):
    return pages(spark, folder).select("url", F.when(F.col("url").rlike(fn.BLOG_AT_INGEST), "blog").otherwise("article").alias("kind"))


@query(r"SELECT url, CASE WHEN regexp_matches(url, '(?i)(^|\.)blog\.|/blog/|/posts?/|/engineering/|/research/') THEN 'blog' ELSE 'article' END AS kind FROM pages")
def p10_kind_on_list(spark, folder):
    return pages(spark, folder).select("url", F.when(F.col("url").rlike(fn.BLOG_ON_LIST), "blog").otherwise("article").alias("kind"))


@query(r"SELECT url, regexp_matches(lower(trim(url)), '^https?://') AND NOT regexp_matches(lower(trim(url)), '(?i)arxiv\.org|^\d{4}\.\d{4,5}(v\d+)?$|^[a-z\-]+/\d{7}$') AS web FROM pages")
def p08_web_address(spark, folder):
    low = F.lower(F.trim("url"))
    return pages(spark, folder).select("url", (low.rlike(r"^https?://") & ~low.rlike(fn.ARXIV_LIKE)).alias("web"))


@query(r"SELECT url, CASE WHEN regexp_matches(lower(url), '\.pdf$') THEN 'pdf' WHEN regexp_matches(url, '(?i)arxiv\.org|^\d{4}\.\d{4,5}(v\d+)?$') THEN 'arxiv' WHEN regexp_matches(lower(url), '^https?://') THEN 'web' ELSE 'arxiv' END AS source FROM (SELECT url FROM pages UNION ALL SELECT unnest(['2410.24164v2', 'a/b.PDF', 'https://arxiv.org/abs/2410.24164', 'x']))")
def s30_source_dispatch(spark, folder):
    extra = spark.range(1).select(F.explode(F.array(*map(F.lit, ["2410.24164v2", "a/b.PDF", "https://arxiv.org/abs/2410.24164", "x"]))).alias("url"))
    u = F.col("url")
    kind = F.when(F.lower(u).rlike(r"\.pdf$"), "pdf").when(u.rlike(r"(?i)arxiv\.org|^\d{4}\.\d{4,5}(v\d+)?$"), "arxiv").when(F.lower(u).rlike(r"^https?://"), "web").otherwise("arxiv")
    return pages(spark, folder).select("url").unionByName(extra).select("url", kind.alias("source"))


@query(rf"""WITH p AS (SELECT url, {TITLE} AS title, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS path FROM pages),
w AS (SELECT url, string_split(regexp_replace(CASE WHEN host = '' THEN 'web' ELSE host END, '^www\.', ''), '.')[1] AS main,
regexp_replace(left({DASH.format("lower(CASE WHEN title <> '' AND length(url) % 3 > 0 THEN title ELSE string_split(path, '/')[-1] END)", "[^a-z0-9]+")}, 40), '^-+|-+$', '', 'g') AS words FROM p)
SELECT url, regexp_replace(main || '-' || regexp_replace(words, '^(.+)-[^-]{{0,2}}$', '\1'), '^-+|-+$', '', 'g') AS slug FROM w""")
def t20_web_slug(spark, folder):
    """Two pages in three by title, the others by the last segment of their path."""
    title = F.when(F.length("url") % 3 > 0, F.col("title")).otherwise("")
    return pages(spark, folder).select("url", fn.web_slug(F.col("url"), title).alias("slug"))


@query(f"SELECT page_id, {TITLE} AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?is)<html[^>]*lang=\"([a-z]+)\"', 1) AS lang, replace(replace(replace(replace(replace(replace({TITLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS plain_title FROM pages")
def s10_page_metadata(spark, folder):
    return pages(spark, folder).select("page_id", "title", F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("h1"), F.regexp_extract("html", r'(?is)<html[^>]*lang="([a-z]+)"', 1).alias("lang"), fn.unescaped(F.col("title")).alias("plain_title"))


@query(f"""WITH t AS (SELECT page_id, {VISIBLE} AS body, {TITLE} AS title, url FROM pages) SELECT page_id, url, title, length(body) AS n_chars, len(list_filter(string_split(body, ' '), lambda w: w <> '')) AS n_words, length(body) < 500 AS short_body FROM t""")
def s11_page_source(spark, folder):
    """Pages as documents: address, title, size of the readable text, and the warning for short ones."""
    body = fn.visible_text(F.col("html"))
    return pages(spark, folder).select("page_id", "url", "title", F.length(body).alias("n_chars"), F.size(F.filter(F.split(body, " "), lambda w: w != "")).alias("n_words"), (F.length(body) < 500).alias("short_body"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS h, unnest(range(len(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)))) AS pos FROM pages) SELECT page_id, arg_max(h, length(h) * 1000000 - pos) AS title FROM h WHERE length(h) > 10 GROUP BY 1""")
def a31_longest_heading(spark, folder):
    """The longest first-level heading of over 10 characters, the first of equals."""
    found = pages(spark, folder).select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1))).alias("pos", "h")).where("length(h) > 10")
    return found.groupBy("page_id").agg(F.max_by("h", F.struct(F.length("h"), -F.col("pos"))).alias("title"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '(?i)href="([^"]*)"', 1)))) AS pos FROM pages), u AS (SELECT page_id, href, min(pos) AS pos FROM l GROUP BY 1, 2) SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM u QUALIFY n <= 30""")
def x07_first_links(spark, folder):
    """Targets of a page, first occurrence of each, numbered without gaps; 30 at most."""
    from pyspark.sql import Window

    links = pages(spark, folder).select("page_id", F.posexplode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]*)"'), F.lit(1)))).alias("pos", "href"))
    return links.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where("n <= 30").select("page_id", "href", "n")


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT href, NOT (regexp_matches(href, '(?i)logo|icon|avatar|sprite') OR starts_with(href, 'data:')) AS wanted, count(*) AS n FROM l GROUP BY 1, 2")
def p17_decorative_targets(spark, folder):
    links = pages(spark, folder).select(F.explode(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("href", (~(F.col("href").rlike(fn.DECORATIVE) | F.startswith("href", F.lit("data:")))).alias("wanted")).agg(F.count(F.lit(1)).alias("n"))


ARXIV_TEXTS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://arxiv.org/abs/' || (2000 + doc_id % 900) || '.' || lpad(doc_id::VARCHAR, greatest(5, length(doc_id::VARCHAR))::INT, '0') || 'v2' WHEN 1 THEN ' 2410.24164v3 ' WHEN 2 THEN 'arxiv.org/pdf/2410.1234' ELSE left(text, 60) END AS s FROM documents"


@query(rf"SELECT doc_id, coalesce(nullif(regexp_extract(s, 'arxiv\.org/(?:abs|pdf)/(\d{{4}}\.\d{{4,5}})(?:v\d+)?', 1), ''), nullif(regexp_extract(trim(s), '^(\d{{4}}\.\d{{4,5}})(?:v\d+)?$', 1), '')) AS id FROM ({ARXIV_TEXTS})")
def t21_arxiv_id(spark, folder):
    d = F.col("doc_id").cast("string")
    s = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://arxiv.org/abs/"), (2000 + F.col("doc_id") % 900).cast("string"), F.lit("."), F.lpad(d, F.greatest(F.lit(5), F.length(d)), F.lit("0")), F.lit("v2"))).when(F.col("doc_id") % 4 == 1, " 2410.24164v3 ").when(F.col("doc_id") % 4 == 2, "arxiv.org/pdf/2410.1234").otherwise(F.substring("text", 1, 60))
    return table(spark, folder, "documents").select("doc_id", fn.arxiv_id(s).alias("id"))


@query("SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 20 AND length(x) < 200 AND NOT starts_with(lower(x), 'arxiv'))[1] AS title FROM documents")
def t22_first_title_line(spark, folder):
    return table(spark, folder, "documents").select("doc_id", fn.first_title_line(F.col("text")).alias("title"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\r\n]+'), lambda x: trim(regexp_replace(x, '[ \t\n\r\x0B\f]+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
o AS (SELECT doc_id, l, CASE WHEN starts_with(lower(l[1]), 'arxiv:') AND len(l) > 1 THEN l[2] ELSE l[1] END AS one FROM l), t AS (SELECT doc_id, CASE WHEN length(one) < 15 AND len(l) > 1 THEN one || ' ' || l[2] ELSE one END AS t FROM o)
SELECT doc_id, CASE WHEN length(t) >= 5 THEN left(t, 300) END AS title FROM t""")
def t23_first_page_title(spark, folder):
    return table(spark, folder, "documents").select("doc_id", fn.first_page_title(F.col("text")).alias("title"))


@query(r"SELECT page_id, length(t) BETWEEN 5 AND 300 AND NOT regexp_matches(lower(trim(t)), '\.(pdf|docx|doc|tex|dvi)$') AND NOT contains(lower(trim(t)), 'microsoft word') AND NOT starts_with(lower(trim(t)), 'untitled') AND NOT regexp_matches(t, '[\n\r]') AS ok FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'report-' || page_id || '.pdf' WHEN 1 THEN 'Untitled' ELSE " + TITLE + " END AS t FROM pages)")
def p15_looks_like_title(spark, folder):
    t = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("report-"), F.col("page_id").cast("string"), F.lit(".pdf"))).when(F.col("page_id") % 5 == 1, "Untitled").otherwise(F.col("title"))
    return pages(spark, folder).select("page_id", fn.looks_like_title(t).alias("ok"))


@query(r"SELECT url, left(CASE WHEN w = '' THEN 'paper' ELSE w END, 48) AS slug FROM (SELECT url, lower(regexp_replace(regexp_replace(regexp_replace(string_split(url, '/')[-1], '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS w FROM pages)")
def t24_file_slug(spark, folder):
    return pages(spark, folder).select("url", fn.file_slug(F.col("url")).alias("slug"))


HEADS = "(SELECT doc_id, (CASE doc_id % 4 WHEN 0 THEN 'IV. ' WHEN 1 THEN (doc_id % 9 + 1) || '.2 ' WHEN 2 THEN '- ' ELSE '' END) || string_split(text, chr(10))[1] || (CASE doc_id % 3 WHEN 0 THEN ' 방법' ELSE ' \\& End' END) AS h FROM documents)"


def headings(spark, folder):
    d = F.col("doc_id")
    lead = F.when(d % 4 == 0, "IV. ").when(d % 4 == 1, F.concat((d % 9 + 1).cast("string"), F.lit(".2 "))).when(d % 4 == 2, "- ").otherwise("")
    h = F.concat(lead, F.element_at(F.split("text", "\n"), 1), F.when(d % 3 == 0, " 방법").otherwise(" \\& End"))
    return table(spark, folder, "documents").select("doc_id", h.alias("h"))


@query(f"""SELECT doc_id, CASE WHEN {DASH.format('lower(h)', '[^a-z0-9]+')} = '' THEN 'section' ELSE {DASH.format('lower(h)', '[^a-z0-9]+')} END AS slug_ascii, {DASH.format('lower(h)', '[^a-z0-9가-힣]+')} AS slug_hangul,
lower(regexp_replace(regexp_replace(h, '^[IVX]+\\.\\s*|\\d+(\\.\\d+)?\\s+', '', 'g'), '[^A-Za-z0-9가-힣]+', '-', 'g')) AS reference_id,
regexp_replace(regexp_replace(lower(trim(h)), '^[\\d\\-.]+', ''), '^-+|-+$', '', 'g') AS without_numbering, regexp_replace(lower(h), '[^a-z0-9]', '', 'g') AS alnum_key,
lower({SQUEEZE.format('h')}) AS heading_key, lower({SQUEEZE.format("replace(h, chr(92), '')")}) AS unescaped_heading_key FROM {HEADS}""")
def t25_seven_normalizers(spark, folder):
    names = ("slug_ascii", "slug_hangul", "reference_id", "without_numbering", "alnum_key", "heading_key", "unescaped_heading_key")
    return headings(spark, folder).select("doc_id", *[getattr(fn, n)(F.col("h")).alias(n) for n in names])


@query(rf"""SELECT doc_id, regexp_extract(h, '^([IVX]+|\d+(?:\.\d+)*)\.?\s+(\S.*)$', 1) AS number, CASE WHEN regexp_extract(h, '^([IVX]+|\d+(?:\.\d+)*)\.?\s+(\S.*)$', 1) = '' THEN h ELSE regexp_extract(h, '^([IVX]+|\d+(?:\.\d+)*)\.?\s+(\S.*)$', 2) END AS title,
len(string_split(regexp_extract(h, '^([IVX]+|\d+(?:\.\d+)*)\.?\s+(\S.*)$', 1), '.')) - 1 AS depth FROM {HEADS}""")
def t18_heading_parts(spark, folder):
    return headings(spark, folder).select("doc_id", fn.heading_parts(F.col("h")).alias("p")).select("doc_id", "p.number", "p.title", "p.depth")


@query(r"SELECT DISTINCT regexp_replace(regexp_replace(f, '\.[^.]+$', ''), '-\d+$', '') AS base FROM (SELECT replace(p_name, ' ', '-') || '-' || p_size || '.png' AS f FROM part)")
def t32_illustration_base(spark, folder):
    f = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string"), F.lit(".png"))
    return table(spark, folder, "part").select(fn.illustration_base(f).alias("base")).distinct()


@query(r"SELECT DISTINCT p_name, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(p_name, '[:\-]', ' ', 'g'), '\s+'), lambda w: w <> '')[1:2], lambda w: upper(w[1])), '') AS initials FROM part")
def t33_initials(spark, folder):
    return table(spark, folder, "part").select("p_name", fn.initials(F.col("p_name")).alias("initials")).distinct()


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def t34_html_escape(spark, folder):
    return pages(spark, folder).select("page_id", fn.escaped(F.col("html")).alias("escaped"))


@query(r"SELECT url, regexp_extract(u, 'github\.com[/:]([^/]+)/([^/#?]+)', 1) AS owner, regexp_replace(regexp_extract(u, 'github\.com[/:]([^/]+)/([^/#?]+)', 2), '\.git$', '') AS name FROM (SELECT url, 'https://github.com/' || string_split(url, '/')[4] || '/r' || page_id || (CASE WHEN page_id % 2 = 0 THEN '.git' ELSE '#readme' END) AS u FROM pages)")
def t39_repository(spark, folder):
    u = F.concat(F.lit("https://github.com/"), F.element_at(F.split("url", "/"), 4), F.lit("/r"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".git").otherwise("#readme"))
    return pages(spark, folder).select("url", fn.repository(u).alias("r")).select("url", "r.owner", "r.name")


@query(r"WITH v AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'v' || (p_size // 10) || '.' || (p_size % 10) || '.' || (p_partkey % 7) WHEN 1 THEN p_size || '.1' ELSE p_size || '.2.3-rc1' END AS v FROM part) SELECT p_partkey, v, CASE WHEN regexp_matches(v, '^v?\d+\.\d+\.\d+$') THEN list_transform(string_split(ltrim(v, 'v'), '.'), lambda x: x::INT) > [2, 5, 3] END AS newer FROM v")
def t40_newer_version(spark, folder):
    p = F.col("p_partkey")
    size = F.col("p_size")
    v = F.when(p % 3 == 0, F.concat(F.lit("v"), F.floor(size / 10).cast("string"), F.lit("."), (size % 10).cast("string"), F.lit("."), (p % 7).cast("string"))).when(p % 3 == 1, F.concat(size.cast("string"), F.lit(".1"))).otherwise(F.concat(size.cast("string"), F.lit(".2.3-rc1")))
    return table(spark, folder, "part").select("p_partkey", v.alias("v"), (fn.version(v) > F.array(F.lit(2), F.lit(5), F.lit(3))).alias("newer"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?m)[ \t\r\x0B\f]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents")
def w11_blank_lines(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(fn.tidy_blank_lines(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[*_]+|[*_]+$', '', 'g')), chr(10))) AS digest FROM documents")
def t10_deemphasized_lines(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(fn.deemphasized(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, md5(array_to_string(list_transform(string_split(m, chr(10) || '### '), lambda x: x), chr(10) || '### ')) = md5(m) AS same, len(string_split(m, chr(10) || '### ')) AS sections FROM (SELECT conv_id, turn, replace(text, chr(10), chr(10) || '### ') AS m FROM conversations)")
def t37_section_round_trip(spark, folder):
    m = F.replace("text", F.lit("\n"), F.lit("\n### "))
    parts = F.split(m, "\n### ")
    return table(spark, folder, "conversations").select("conv_id", "turn", (F.array_join(parts, "\n### ") == m).alias("same"), F.size(parts).alias("sections"))


@query("SELECT conv_id, turn, md5(regexp_replace(m, '(?s)\\A---\\n.*?\\n---\\n', '')) AS digest FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '---' || chr(10) || 'role: ' || role || chr(10) || '---' || chr(10) || text ELSE text END AS m FROM conversations)")
def t38_frontmatter_stripped(spark, folder):
    m = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("---\nrole: "), F.col("role"), F.lit("\n---\n"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.md5(F.regexp_replace(m, r"(?s)\A---\n.*?\n---\n", "").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, token, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS token FROM conversations WHERE conv_id % 10 = 0) WHERE regexp_matches(token, '[\\p{L}\\p{N}]') AND NOT regexp_matches(token, '[<>]') GROUP BY 1, 2, 3".replace(" WHERE conv_id % 10 = 0", ""))
def p19_markable_tokens(spark, folder):
    """Tokens with a letter or a number and without markup."""
    tokens = table(spark, folder, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("token"))
    return tokens.where(F.col("token").rlike(r"[\p{L}\p{N}]") & ~F.col("token").rlike("[<>]")).groupBy("conv_id", "turn", "token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, t = '' OR starts_with(t, '_(') OR starts_with(t, '*(') OR contains(t, '미진행') OR contains(t, '여기에 본인 답변') OR t = '<empty>' AS placeholder FROM (SELECT conv_id, turn, trim(CASE (conv_id + turn) % 6 WHEN 0 THEN '_(later)_' WHEN 1 THEN ' ' WHEN 2 THEN '<empty>' WHEN 3 THEN '(미진행)' ELSE text END) AS t FROM conversations)")
def p13_placeholder(spark, folder):
    k = (F.col("conv_id") + F.col("turn")) % 6
    t = F.trim(F.when(k == 0, "_(later)_").when(k == 1, " ").when(k == 2, "<empty>").when(k == 3, "(미진행)").otherwise(F.col("text")))
    found = (t == "") | F.startswith(t, F.lit("_(")) | F.startswith(t, F.lit("*(")) | F.contains(t, F.lit("미진행")) | F.contains(t, F.lit("여기에 본인 답변")) | (t == "<empty>")
    return table(spark, folder, "conversations").select("conv_id", "turn", found.alias("placeholder"))


@query("SELECT doc_id, regexp_matches(source, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AND NOT contains(source, '/') AS safe FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '../' || source WHEN 1 THEN '.' || source ELSE source END AS source FROM documents)")
def p24_safe_name(spark, folder):
    s = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("../"), "source")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("."), "source")).otherwise(F.col("source"))
    return table(spark, folder, "documents").select("doc_id", (s.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~F.contains(s, F.lit("/"))).alias("safe"))


@query("SELECT doc_id, n_chars > 200 AND length(left(text, 100 + doc_id % 400)) < 0.5 * n_chars AS shrinks FROM documents")
def p28_shrink_guard(spark, folder):
    """A saved text of over 200 characters mustn't lose more than half of them."""
    return table(spark, folder, "documents").select("doc_id", ((F.col("n_chars") > 200) & (F.length(F.substring("text", F.lit(1), (F.lit(100) + F.col("doc_id") % 400).cast("int"))) < 0.5 * F.col("n_chars"))).alias("shrinks"))


@query("SELECT doc_id, left(text, 8000) = text AS whole_8000, length(left(text, 5000)) AS head_5000, length(left(text, 1500)) AS head_1500, left(text, 200) AS head_200 FROM documents")
def o12_prefix_limits(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", (F.substring("text", 1, 8000) == F.col("text")).alias("whole_8000"), F.length(F.substring("text", 1, 5000)).alias("head_5000"), F.length(F.substring("text", 1, 1500)).alias("head_1500"), F.substring("text", 1, 200).alias("head_200"))


@query(r"""WITH h AS (SELECT doc_id, left(text, 5000) AS h, text FROM documents) SELECT doc_id, len(regexp_extract_all(h, '(?i)cid:\d+')) > 5 AS broken_glyphs, len(list_filter(string_split(h, chr(10)), lambda x: length(x) > 500)) > 2 AS broken_lines, length(text) < 500 AS short_body FROM h""")
def a20_extraction_quality(spark, folder):
    h = F.substring("text", 1, 5000)
    return table(spark, folder, "documents").select("doc_id", (F.regexp_count(h, F.lit(r"(?i)cid:\d+")) > 5).alias("broken_glyphs"), (F.size(F.filter(F.split(h, "\n"), lambda x: F.length(x) > 500)) > 2).alias("broken_lines"), (F.length("text") < 500).alias("short_body"))


@query(r"""WITH h AS (SELECT doc_id, left(text, 5000) AS h, text FROM documents), w AS (SELECT doc_id, unnest([CASE WHEN len(regexp_extract_all(h, '(?i)cid:\d+')) > 5 THEN 'glyphs' END, CASE WHEN len(list_filter(string_split(h, chr(10)), lambda x: length(x) > 500)) > 2 THEN 'long lines' END, CASE WHEN length(text) < 500 THEN 'short body' END]) AS warning FROM h) SELECT warning, count(*) AS documents FROM w WHERE warning IS NOT NULL GROUP BY 1""")
def g10_extraction_warnings(spark, folder):
    flags = a20_extraction_quality(spark, folder)
    names = F.array(F.when(F.col("broken_glyphs"), "glyphs"), F.when(F.col("broken_lines"), "long lines"), F.when(F.col("short_body"), "short body"))
    return flags.select(F.explode(F.filter(names, lambda n: n.isNotNull())).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("documents"))


@query(r"SELECT doc_id, regexp_replace(t, '\\{1,2}(rowcolors?|cellcolor|columncolor)\s*(\[[^\]]*\])?\s*(\{[^}]*\}|[\d.]+)?\s*|\\{1,2}(hline|toprule|midrule|bottomrule)\b|\\{1,2}cline\s*\{[^}]*\}', '', 'g') AS cleaned FROM (SELECT doc_id, '\hline ' || text || ' \\cellcolor[gray]{0.9} 1 & \cline{2-3} 2 \toprule' AS t FROM documents)")
def t15_latex_residue(spark, folder):
    t = F.concat(F.lit("\\hline "), "text", F.lit(" \\\\cellcolor[gray]{0.9} 1 & \\cline{2-3} 2 \\toprule"))
    return table(spark, folder, "documents").select("doc_id", fn.latex_residue_removed(t).alias("cleaned"))


@query(r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'a' || chr(10) || '1. ' || string_split(text, chr(10))[1] || chr(10) || '- _later_' || chr(10) || '* second' ELSE text END AS t FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_extract_all(t, '(?m)^\s*(?:\d+\.|[-*])[ \t]+(\S.*)$', 1), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '_')), '|') AS items FROM t""")
def t06_numbered_items(spark, folder):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("a\n1. "), F.element_at(F.split("text", "\n"), 1), F.lit("\n- _later_\n* second"))).otherwise(F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(fn.numbered_items(t), "|").alias("items"))


@query("SELECT p_partkey, CASE WHEN name = '' THEN 'Section' ELSE upper(name[1]) || replace(name[2:], '-', ' ') END AS title FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS name FROM part)")
def t13_title_from_id(spark, folder):
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    return table(spark, folder, "part").select("p_partkey", F.when(name == "", "Section").otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.replace(F.substring(name, 2, 1000), F.lit("-"), F.lit(" ")))).alias("title"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '## '))) AS pending FROM (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || '## ') AS text FROM documents)")
def a27_pending_requests(spark, folder):
    lines = F.split(F.replace("text", F.lit(".\n"), F.lit(".\n## ")), "\n")
    return table(spark, folder, "documents").select("doc_id", F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("## ")))).alias("pending"))


@query("SELECT doc_id, starts_with(text, applied) AS matches, substr(text, length(applied) + 1) AS remainder FROM (SELECT doc_id, text, left(CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END, 120) AS applied FROM documents)")
def x12_merge_split(spark, folder):
    """What was applied is a prefix of the log; the remainder is what came meanwhile."""
    applied = F.substring(F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")), 1, 120)
    rows = table(spark, folder, "documents").select("doc_id", "text", applied.alias("applied"))
    return rows.select("doc_id", F.startswith("text", F.col("applied")).alias("matches"), F.substring("text", F.length("applied") + 1, F.length("text")).alias("remainder"))


@query("""WITH l AS (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[-1] AS last FROM conversations), t AS (SELECT conv_id, turn, list_filter(list_transform(string_split(last, ','), lambda x: trim(trim(x), ' "#.''')), lambda x: x <> '' AND length(x) <= 24) AS t FROM l),
u AS (SELECT conv_id, turn, lower(tag) AS k, arg_min(tag, pos) AS tag, min(pos) AS pos FROM (SELECT conv_id, turn, unnest(t) AS tag, unnest(range(len(t))) AS pos FROM t) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM u)
SELECT t.conv_id AS conv_id, t.turn AS turn, coalesce(string_agg(r.tag, '|' ORDER BY r.pos), '') AS tags FROM t LEFT JOIN r ON r.conv_id = t.conv_id AND r.turn = t.turn AND r.n <= 6 GROUP BY 1, 2""")
def x06_parsed_tags(spark, folder):
    """Tags from the last line of an answer: stripped, 24 characters at most, first spelling of each, six at most."""
    from ..operators.library import first_of_each

    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    last = F.try_element_at(lines, F.lit(-1))
    tags = F.filter(F.transform(F.split(last, ","), lambda x: F.regexp_replace(F.trim(x), r"""^[ "#.']+|[ "#.']+$""", "")), lambda x: (x != "") & (F.length(x) <= 24))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.coalesce(F.array_join(F.slice(first_of_each(tags), 1, 6), "|"), F.lit("")).alias("tags"))


@query("""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS t FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(t, lambda x: length(x) <= 24)[1:6], '|') AS tokens FROM t""")
def o10_token_cap(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(F.slice(F.filter(F.split("text", " "), lambda x: F.length(x) <= 24), 1, 6), "|").alias("tokens"))


LABELS = {"en": "Summary", "fr": "Résumé", "de": "Zusammenfassung"}


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'Summary' WHEN 'fr' THEN 'Résumé' WHEN 'de' THEN 'Zusammenfassung' ELSE 'Summary' END AS label FROM documents")
def g15_label_lookup(spark, folder):
    """A dimension table of labels; an unknown kind has the default's."""
    labels = spark.createDataFrame(list(LABELS.items()), "lang string, label string")
    return table(spark, folder, "documents").select("doc_id", "lang").join(F.broadcast(labels), "lang", "left").select("doc_id", F.coalesce("label", F.lit(LABELS["en"])).alias("label"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'paper' WHEN 'fr' THEN 'blog' WHEN 'de' THEN 'article' ELSE 'paper' END AS rubric FROM documents")
def u02_rubric(spark, folder):
    rubric = F.when(F.col("lang") == "fr", "blog").when(F.col("lang") == "de", "article").otherwise("paper")
    return table(spark, folder, "documents").select("doc_id", rubric.alias("rubric"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, CASE WHEN doc_id % 2 = 0 THEN lang END, 'default') AS setting FROM documents")
def u07_setting_precedence(spark, folder):
    """Environment before file before default."""
    return table(spark, folder, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.lit("default")).alias("setting"))


@query("SELECT doc_id, 'Read lines ' || (doc_id * 3) || '-' || (doc_id * 3 + 9) || ' of ' || source || ', section ' || lang AS prompt FROM documents")
def u04_prompt(spark, folder):
    d = F.col("doc_id")
    return table(spark, folder, "documents").select("doc_id", F.format_string("Read lines %d-%d of %s, section %s", d * 3, d * 3 + 9, "source", "lang").alias("prompt"))


@query("SELECT doc_id, len(list_filter(asked, lambda x: x NOT IN ('detail', 'summary'))) = 0 AND len(asked) > 0 AS valid FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['detail'] WHEN 1 THEN ['detail', 'summary'] WHEN 2 THEN ['detail', lang] ELSE []::VARCHAR[] END AS asked FROM documents)")
def p32_publish_targets(spark, folder):
    k = F.col("doc_id") % 4
    asked = F.when(k == 0, F.array(F.lit("detail"))).when(k == 1, F.array(F.lit("detail"), F.lit("summary"))).when(k == 2, F.array(F.lit("detail"), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    return table(spark, folder, "documents").select("doc_id", ((F.size(F.array_except(asked, F.array(F.lit("detail"), F.lit("summary")))) == 0) & (F.size(asked) > 0)).alias("valid"))
