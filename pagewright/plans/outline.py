"""Plans over blocks: scans, cleaning, predicates, statistics, scoring, titles, hierarchy. Each renders one SELECT."""

from __future__ import annotations

from ..functions.dialect import Spark, any_of, any_rx, cases, count_of, is_title, is_upper, jaccard, pts
from . import constants as C

#: Pages of a document that are read, as the scan has it.
PAGE_CAP = 50
#: Lines that the adapter puts in, so that every table of patterns has something to find.
PHRASES = ["Executive Summary", "Background", "Timeline:", "2. Terms of Reference", "3. Membership", "Appendix B", "Approach and Specific Goals", "Methodology and Results", "API Reference and Installation", "Market Analysis and Budget", "Chapitre 4 : résumé et conclusion", "Kapitel 2 Zusammenfassung", "Capítulo 5 Conclusión", "第3章 概要", "第２节 引言", "What is a Framework?", "A report: an overview", "Annual Study - Report"]


def adapter(d: Spark, cap: bool = True) -> str:
    """CTEs lines, blocks: the text lines of `documents` as blocks with font and place, the same rows in any engine. With
    the cap, pages after PAGE_CAP are left out and lines of contents keep 30 characters."""
    wc = d.size(d.filt(d.split("line", r"[ \t]+"), "x", "x <> ''"))
    src = d.explode("doc_id, pos, trim(raw) AS line", f"split(text, {d.nl})" if d.name == "spark" else f"string_split(text, {d.nl})", "raw", "documents", "pos")
    n = "cast(seq AS string)" if d.name == "spark" else "cast(seq AS varchar)"
    k = f"{d.idiv('seq', '9')} + doc_id"
    phrase = cases(*[(f"({k}) % {len(PHRASES)} = {i}", d.s(x)) for i, x in enumerate(PHRASES)])
    third = f"cast({d.idiv('seq', '27')} AS {'string' if d.name == 'spark' else 'varchar'})"
    text = cases(("doc_id % 3 = 0 AND seq % 8 = 7", "'Confidential draft'"), ("doc_id % 4 = 1 AND seq % 9 = 7", phrase), ("seq % 9 = 2", f"{n} || '. ' || line"), ("seq % 9 = 4", f"{n} || '.1 ' || line"), ("seq % 9 = 6", f"{'substring(line, 1, 30)' if cap else 'line'} || ' ..... ' || {n}"), ("doc_id % 2 = 0 AND seq % 9 = 8", f"'Page ' || {third}"), ("seq % 9 = 8", f"'Page ' || {n}"), other="line")
    size = cases(("seq = 0", d.f(20)), ("wc <= 3", d.f(16)), ("wc <= 8", d.f(13)), other=f"{d.f(10)} + (length(line) % 3) * {d.f(0.5)}")
    return f"""lines AS ({src}),
counted AS (SELECT doc_id, cast(pos AS int) AS seq, line, {wc} AS wc FROM lines),
placed AS (SELECT doc_id, seq, {d.idiv('seq', '8')} AS page, text, {size} AS font_size, wc <= 6 AS is_bold, length(line) % 7 = 0 AS is_italic,
  {d.f(72)} + (length(line) % 4) * {d.f(12)} AS x0, {d.f(72)} + (seq % 8) * {d.f(80)} AS y0 FROM ({d.once('doc_id, seq, line, wc', text, 'text', 'counted')}) z),
blocks AS (SELECT *, x0 + least({d.f(400)}, {d.f(5)} * length(text)) AS x1, y0 + font_size AS y1 FROM placed{f' WHERE page < {PAGE_CAP}' if cap else ''})"""


def whole(d: Spark) -> str:
    """The adapter over all pages and whole lines."""
    return adapter(d, cap=False)


def is_noise(t: str, lt: str, d: Spark) -> str:
    return f"(length({t}) < 2 OR length({t}) > 500 OR {any_rx(t, C.FORM, d)} OR {any_rx(lt, C.TOC + C.NOISE, d)})"


def is_simple_noise(t: str, lt: str, d: Spark) -> str:
    return f"({any_rx(lt, C.SIMPLE_NOISE, d)} OR {any_rx(t, [r'\.{3,}\s*\d+$', r'^[0-9.]+\s+\d+\s+[A-Z]+\s+\d+'], d)})"


def is_likely_content(t: str, lt: str, wc: str, d: Spark) -> str:
    return f"(length({t}) > 100 OR {wc} > 15 OR {d.rx(t, r'[.!?]\s')} OR {count_of(lt, C.CONTENT_WORDS, d)} >= 2)"


def language(t: str, d: Spark) -> str:
    lt = f"lower({t})"
    return cases(
        (f"{t} = ''", "'unknown'"),
        (d.rx(t, "[぀-ゟ゠-ヿ]"), "'japanese'"),
        (f"{d.rx(t, '[一-龯]')} AND {d.rx(t, r'第\p{Nd}+章|第\p{Nd}+節')}", "'japanese'"),
        (f"{d.rx(t, '[一-鿿]')} AND {d.rx(t, r'第\p{Nd}+章|第\p{Nd}+节')}", "'chinese'"),
        (d.rx(t, "[가-힯]"), "'korean'"),
        (f"{d.rx(t, '[àâäçéèêëîïôöùûüÿ]')} OR {any_of(lt, ['chapitre', 'résumé'], d)}", "'french'"),
        (f"{d.rx(t, '[äöüß]')} OR {any_of(lt, ['kapitel', 'zusammenfassung'], d)}", "'german'"),
        (f"{d.rx(t, '[áéíóúüñ]')} OR {any_of(lt, ['capítulo', 'resumen'], d)}", "'spanish'"),
        other="'english'",
    )


def base(d: Spark) -> str:
    """Adds trimmed and lower text, words, case flags and language to blocks."""
    return f"""base AS (SELECT *, cast({d.size('ws')} AS int) AS wc, {is_upper('t', d)} AS isup, {is_title('t', d)} AS ttl, {is_noise('t', 'lt', d)} AS noise, {language('t', d)} AS language
  FROM (SELECT *, trim(text) AS t, lower(trim(text)) AS lt, {d.words('text')} AS ws FROM blocks))"""


WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def deduped(d: Spark) -> str:
    """uniq: blocks without noise and repeats (the repeated-element filter follows and finds nothing left to drop), beside
    what is known of their document: its language, mean and largest font, and how many such blocks it has. One scan, and
    one exchange by document, which all windows share."""
    size = "CASE WHEN NOT noise AND rn = 1 AND font_size > 0 THEN font_size END"
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, noise, lt ORDER BY seq) AS rn, count(*) OVER (PARTITION BY doc_id, language) AS lang_n, min(seq) OVER (PARTITION BY doc_id, language) AS lang_first FROM (SELECT /*+ REPARTITION(doc_id) */ * FROM base) z0),
told AS (SELECT *, first_value(language) OVER (PARTITION BY doc_id ORDER BY lang_n DESC, lang_first {WHOLE}) AS doc_language, coalesce(avg({size}) OVER (PARTITION BY doc_id), {d.f(12)}) AS fa, coalesce(max({size}) OVER (PARTITION BY doc_id), {d.f(12)}) AS fm, count(CASE WHEN NOT noise AND rn = 1 THEN 1 END) OVER (PARTITION BY doc_id) AS n_blocks FROM numbered),
uniq AS (SELECT * FROM told WHERE NOT noise AND rn = 1)"""


def clean_heading(t: str, d: Spark) -> str:
    return d.rep(f"trim({d.rep(t, r'\s+', ' ')})", r"\.+$", "")


def heading_rules(d: Spark) -> tuple[str, str, str]:
    """limits: uniq with the font thresholds of each document; and the score and level of a row of it."""
    rng, avg = "(fm - fa)", "fa"
    thr = lambda k, m: f"CASE WHEN {rng} > {d.f(2)} THEN {avg} + {rng} * {d.f(k)} ELSE {avg} * {d.f(m)} END"
    number = f"({d.rx('t', r'^\d+\.\s+[A-Z]')} AND NOT {any_of('lt', C.FORM_WORDS, d)})"
    number2 = f"(NOT {number} AND {d.rx('t', r'^\d+\.\d+\s+[A-Z]')})"
    colon = f"(NOT {number} AND NOT {number2} AND right(t, 1) = ':' AND wc <= 6)"
    major = f"({any_of('lt', C.MAJOR, d)} AND wc <= 3)"
    cjk = "doc_language IN ('japanese', 'chinese')"
    chap, sect = f"({cjk} AND {d.rx('t', r'^第\p{Nd}+章')})", f"({cjk} AND {d.rx('t', r'^第\p{Nd}+節|^第\p{Nd}+节')})"
    score = " + ".join([
        pts(d, ("font_size >= h1", 4), ("font_size >= h2", 3), ("font_size >= h3", 2), (f"font_size > fa * {d.f(1.05)}", 1)),
        pts(d, ("is_bold", 2)), pts(d, (number, 3), (number2, 3), (colon, 2)), pts(d, (major, 6)), pts(d, (chap, 5), (sect, 4)),
        pts(d, (any_of("lt", C.SECTION_WORDS, d), 2)), pts(d, ("isup AND wc BETWEEN 3 AND 8", 2)),
    ])
    level = cases((chap, "'H1'"), (sect, "'H2'"), (major, "'H2'"), (number, "'H2'"), (number2, "'H3'"), ("font_size >= h1", "'H1'"), ("font_size >= h2", "'H2'"), (f"font_size >= h3 OR font_size > fa * {d.f(1.05)}", "'H3'"), (f"is_bold OR {colon}", "'H3'"))
    return f"limits AS (SELECT *, {thr(.7, 1.4)} AS h1, {thr(.4, 1.2)} AS h2, {thr(.2, 1.1)} AS h3 FROM uniq)", score, level


def scored(d: Spark) -> str:
    limits, score, level = heading_rules(d)
    return f"{limits},\nscored AS (SELECT *, {score} AS score, {level} AS level FROM limits WHERE wc <= 20)"


def section_level(d: Spark) -> str:
    return cases(*[(d.rx("lt", p), f"'{v}'") for p, v in C.SECTIONS])


def proposed(d: Spark) -> str:
    """Each block of uniq twice: as a scored heading (kind 0) and as a section heading (kind 1), where it is one (ok)."""
    limits, score, level = heading_rules(d)
    cols = "doc_id, seq, page, y0, t, lt, wc, font_size, is_bold, isup, noise, doc_language, n_blocks, htext, score0, level0, section, kind"
    both = d.explode(cols, d.arr(["0", "1"]), "kind", f"(SELECT *, {clean_heading('t', d)} AS htext, {score} AS score0, {level} AS level0, {section_level(d)} AS section FROM limits) z")
    return f"""{limits},
twice AS ({both}),
proposed AS (SELECT *, CASE WHEN kind = 0 THEN score0 ELSE {d.f(10)} END AS score, CASE WHEN kind = 0 THEN level0 ELSE section END AS level, htext <> '' AND CASE WHEN kind = 0 THEN wc <= 20 AND score0 >= {d.f(3)} AND level0 IS NOT NULL ELSE section IS NOT NULL END AS ok FROM twice)"""


def headings(d: Spark) -> str:
    """heads(doc_id, pos, text, page, score, y0, raw, lv): sorted, deduplicated, with repaired levels."""
    return f"""{proposed(d)},
single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(htext) ORDER BY page, y0, kind, seq) AS nth FROM proposed WHERE ok) z1 WHERE nth = 1),
ranked AS (SELECT doc_id, page, y0, htext AS text, score, cast(right(level, 1) AS int) AS raw, cast(row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, kind, seq) AS int) AS pos FROM single),
heads AS (SELECT doc_id, pos, page, y0, text, score, raw, pos + min(raw - pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lv FROM ranked)"""


def all_rows(d: Spark) -> str:
    """As headings, with the other blocks still there: head tells which rows are headings."""
    return f"""{proposed(d)},
marked AS (SELECT *, ok AND nth = 1 AS head FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ok, lower(htext) ORDER BY page, y0, kind, seq) AS nth, row_number() OVER (PARTITION BY doc_id, kind = 0 AND page = 0 ORDER BY font_size DESC, y0, seq) AS rank FROM proposed) z1),
placed_rows AS (SELECT *, cast(right(level, 1) AS int) AS raw, cast(row_number() OVER (PARTITION BY doc_id, head ORDER BY page, y0, kind, seq) AS int) AS pos FROM marked),
rows_ AS (SELECT *, pos + min(raw - pos) OVER (PARTITION BY doc_id, head ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lv FROM placed_rows)"""


def title_text(d: Spark, first: str) -> str:
    """The title among rows of one document, where `first` holds for blocks of the first page and rank orders them by size."""
    wanted = f"(wc BETWEEN 3 AND 25 AND length(t) <= 200 AND font_size >= {d.f(10)} AND right(t, 4) <> '.pdf' AND NOT noise AND ({any_of('lt', C.TITLE_WORDS, d)} OR font_size >= {d.f(14)} OR is_bold OR isup))"
    rfp = f"{first} AND contains(lt, 'rfp') AND contains(lt, 'request') AND contains(lt, 'proposal') AND wc >= 10"
    largest = f"{first} AND rank <= 15 AND {wanted}"
    best = f"coalesce(min_by(CASE WHEN {rfp} THEN t END, CASE WHEN {rfp} THEN rank END), min_by(CASE WHEN {largest} THEN t END, CASE WHEN {largest} THEN rank END))"
    return f"coalesce({d.rep(f'trim({d.rep(best, r'\s+', ' ')})', r'^([Tt][Ii][Tt][Ll][Ee]|[Ss][Uu][Bb][Jj][Ee][Cc][Tt]):\s*')}, 'doc' || {num(d, 'doc_id')})"


def title(d: Spark) -> str:
    return f"titles AS (SELECT doc_id, {title_text(d, 'page = 0')} AS title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page = 0 ORDER BY font_size DESC, y0, seq) AS rank FROM uniq) z2 GROUP BY doc_id)"


class Plan:
    """A SELECT over common table expressions, rendered for an engine; without the adapter it reads a relation `blocks`."""

    def __init__(self, parts: list, select):
        self.parts, self.select = parts, select

    def __call__(self, d: Spark, adapted: bool = True) -> str:
        parts = [p(d) for p in self.parts if adapted or p not in (adapter, whole)]
        return d.finished(("WITH " + ",\n".join(parts) + "\n" if parts else "") + self.select(d))


BASE = [adapter, base]
WHOLE_BASE = [whole, base]
CORE = [*BASE, deduped]
HEADS = [*CORE, headings]


def lvl(d: Spark, c: str = "lv") -> str:
    return f"'H' || cast({c} AS {'string' if d.name == 'spark' else 'varchar'})"


def num(d: Spark, c: str) -> str:
    return f"cast({c} AS {'string' if d.name == 'spark' else 'varchar'})"


PLANS: dict[str, Plan] = {}


def register(*parts):
    def add(f):
        PLANS[f.__name__] = Plan(list(parts), f)
        return f

    return add


@register(adapter)
def block_scan(d):
    return "SELECT doc_id, seq, page, text, font_size, is_bold, is_italic, x0, y0, x1, y1 FROM blocks"


@register(adapter)
def block_scan_simple(d):
    return "SELECT doc_id, seq, page, trim(text) AS text, font_size, is_bold, y0 AS y_pos FROM blocks WHERE length(trim(text)) >= 3"


def span_flags() -> str:
    return "CASE WHEN is_bold THEN 16 ELSE 0 END + CASE WHEN is_italic THEN 2 ELSE 0 END + CASE WHEN seq % 5 = 1 THEN 4 ELSE 0 END + CASE WHEN seq % 7 = 3 THEN 8 ELSE 0 END"


def font_name() -> str:
    return cases(("seq % 4 = 0", "'Arial-BoldMT'"), ("seq % 4 = 1", "'TimesNewRoman'"), ("seq % 4 = 2", "'Calibri'"), other="'CourierNew'")


def spans(d):
    """Words as spans, each with its own box, that of its line and of its block, and the page's."""
    place = f"x0 + span * {d.f(30)}"
    src = d.explode("doc_id, page, seq, span, word, font_size, flags, font, x0, y0, x1, y1, page_x1, page_y1", "ws", "word", f"(SELECT *, {d.words('text')} AS ws, {span_flags()} AS flags, {font_name()} AS font, max(x1) OVER (PARTITION BY doc_id, page) AS page_x1, max(y1) OVER (PARTITION BY doc_id, page) AS page_y1 FROM blocks)", "span")
    return f"spans AS (SELECT *, {place} AS sx0, {place} + {d.f(5)} * length(word) AS sx1 FROM ({src}) z)"


@register(adapter, spans)
def span_scan(d):
    return "SELECT doc_id, page, seq, cast(span AS int) AS span, word AS text, font_size AS size, cast(flags AS int) AS flags, font, sx0 AS x0, y0, sx1 AS x1, y1, x0 AS line_x0, y0 AS line_y0, x1 AS line_x1, y1 AS line_y1, x0 AS block_x0, y0 AS block_y0, x1 AS block_x1, y1 AS block_y1, page_x1 AS page_width, page_y1 AS page_height FROM spans WHERE length(word) >= 2"


@register(adapter, spans)
def span_fonts(d):
    low = "lower(font)"
    bit = lambda n: f"(flags & {1 << n}) <> 0"
    return f"""SELECT DISTINCT doc_id, seq, font_size AS size, {low} AS name, {bit(0)} AS is_superscript, {bit(1)} AS is_italic, {bit(2)} AS is_serifed, {bit(3)} AS is_monospaced, {bit(4)} AS is_bold,
  {any_of(low, C.SANS, d)} AS is_sans_serif, {any_of(low, C.SERIF, d)} AS is_serif, font_size > {d.f(18)} AS is_display_font, font_size > {d.f(14)} AND {bit(4)} AS is_title_font FROM spans"""


@register(adapter, spans)
def spans_to_blocks(d):
    return f"""SELECT * FROM (SELECT doc_id, page, seq, {d.join('word', 'span', ' ')} AS text, max(font_size) AS font_size, bool_or((flags & 16) <> 0) AS is_bold, bool_or((flags & 2) <> 0) AS is_italic FROM spans GROUP BY doc_id, page, seq) WHERE length(text) >= 3"""


@register(adapter)
def layout_rectangles(d):
    """Rectangles wider than 50 and taller than 30, numbered on their page; one frame a block, of uneven height."""
    return f"""SELECT doc_id, page, 'rect_' || {num(d, 'row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) - 1')} AS id, 'rectangle' AS type, x0, y0, x1, bottom AS y1, x1 - x0 AS width, bottom - y0 AS height
  FROM (SELECT *, y1 + (seq % 4) * {d.f(9)} AS bottom FROM blocks) z WHERE x1 - x0 > {d.f(50)} AND bottom - y0 > {d.f(30)}"""


@register()
def input_validation(d):
    """The test of a file's name and size, on made-up names: the suffix in any case, at most 100 MB, not empty."""
    name = f"'doc' || {num(d, 'doc_id')} || CASE WHEN doc_id % 5 = 0 THEN '.txt' WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.pdf' END"
    return f"SELECT doc_id, name, size, lower(name) LIKE '%.pdf' AS is_pdf, size <= 104857600 AS is_small, lower(name) LIKE '%.pdf' AND size <= 104857600 AS valid FROM (SELECT doc_id, {name} AS name, n_chars * CASE WHEN doc_id % 7 = 3 THEN 200000 ELSE 1 END AS size FROM documents) z"


@register(adapter)
def normalised_blocks(d):
    """Blocks as another extractor may leave them, without size, name or box, made whole: the size is the block's, else that
    of its font, else 12; the name likewise, else unknown; blocks without text go."""
    size, other = "CASE WHEN seq % 3 = 1 THEN NULL ELSE font_size END", "CASE WHEN seq % 6 = 1 THEN NULL ELSE font_size + 1 END"
    name, second = f"CASE WHEN seq % 2 = 1 THEN NULL WHEN seq % 10 = 0 THEN '' ELSE {font_name()} END", f"CASE WHEN seq % 4 = 1 THEN NULL ELSE {font_name()} END"
    box = lambda c: f"coalesce(CASE WHEN seq % 5 = 2 THEN NULL ELSE {c} END, {d.f(0)}) AS {c}"
    return f"SELECT doc_id, seq, page, trim(text) AS text, coalesce({size}, {other}, {d.f(12)}) AS font_size, coalesce(nullif({name}, ''), nullif({second}, ''), 'unknown') AS font_name, {', '.join(box(c) for c in ('x0', 'y0', 'x1', 'y1'))} FROM blocks WHERE trim(text) <> ''"


@register(adapter, base)
def estimated_sizes(d):
    """Sizes where none is known: 16 for capitals under 50 characters, 14 for texts under 100, else 12."""
    return f"SELECT doc_id, seq, coalesce(size, {cases(('isup AND length(text) < 50', d.f(16)), ('length(text) < 100', d.f(14)), other=d.f(12))}) AS font_size FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN font_size END AS size FROM base) z"


@register(adapter)
def level_numbers(d):
    """Levels H1 to H6 as numbers and back; anything else counts as 3."""
    name = f"CASE WHEN seq % 8 = 7 THEN 'body' ELSE 'H' || {num(d, 'seq % 8')} END"
    n = cases(*[(f"level = 'H{k}'", str(k)) for k in range(1, 7)], other="3")
    return f"SELECT doc_id, seq, level, number, {cases(*[(f'number = {k}', repr(f'H{k}')) for k in range(1, 7)], other=repr('H3'))} AS name FROM (SELECT *, {n} AS number FROM (SELECT doc_id, seq, {name} AS level FROM blocks) y) z"


@register(adapter)
def time_estimate(d):
    return f"SELECT doc_id, cast(pages AS bigint) AS pages, round({d.f(1)} + {d.f(.15)} * pages, 6) AS seconds FROM (SELECT doc_id, count(DISTINCT page) AS pages FROM blocks GROUP BY doc_id) z"


@register(adapter)
def clean_span_text(d):
    """Runs of four letters and more, then a lone letter before a word."""
    one = f"CASE WHEN length(text) < 4 THEN text ELSE {d.rep(d.runs('text', 4), r'(^|[^\p{L}\p{N}_])[a-zA-Z]\s+([a-zA-Z]{3,})', '$1$2')} END"
    return f"SELECT doc_id, seq, {one} AS text FROM blocks"


@register(whole)
def clean_block_steps(d):
    a = f"trim({d.rep('text', r'\s+', ' ')})"
    b = d.rep(a, r"\b([A-Z])\s+([A-Z])\s+([A-Z])\b", "$1$2$3")
    # Five of the six steps; the repair of substrings repeated three times needs a back-reference (clean_blocks_full).
    c = d.rep(b, r"\b([A-Za-z])\s+([A-Za-z])\s+([A-Za-z])\s+([A-Za-z])\b", "$1$2$3$4")
    return f"SELECT doc_id, seq, {d.rep(d.runs('c', 3), r'\b[a-z]\s+([a-z]{4,})\s+[a-z]+o{3,}r\s+', '$1 for ')} AS text FROM (SELECT doc_id, seq, {c} AS c FROM blocks) z"


@register(adapter)
def clean_heading_text(d):
    return f"SELECT doc_id, seq, {clean_heading('text', d)} AS text FROM blocks"


@register(adapter)
def clean_title_text(d):
    return f"SELECT doc_id, seq, {d.rep(f'trim({d.rep("text", r"\s+", " ")})', r'^([Tt][Ii][Tt][Ll][Ee]|[Ss][Uu][Bb][Jj][Ee][Cc][Tt]):\s*')} AS text FROM blocks"


@register(adapter)
def clean_text_controls(d):
    return f"SELECT doc_id, seq, {d.rep(f'trim({d.rep("text", r"\s+", " ")})', r'[\x00-\x1f]', '')} AS text FROM blocks"


@register(adapter)
def format_headings(d):
    a = d.rep("trim(text)", r"^\d+\.?\s*")
    b = d.rep(a, r"^[A-Z]\.?\s*")
    return f"SELECT doc_id, seq, {d.rep(b, r'^[IVXivx]+\.?\s*')} AS text FROM blocks"


@register(adapter, base)
def noise_flags(d):
    return f"SELECT doc_id, seq, noise, {is_simple_noise('t', 'lt', d)} AS simple_noise, {any_rx('lt', C.SIMPLE_TOC, d)} AS toc, (length(t) < 3 OR {d.rx('t', r'^\d{1,3}$')} OR {any_rx('lt', C.LIKELY_NOISE, d)}) AS likely_noise, {is_likely_content('t', 'lt', 'wc', d)} AS likely_content FROM base"


@register(adapter, base)
def junk_reason(d):
    return f"SELECT doc_id, seq, {cases(*[(any_rx('lt', p, d), repr(k)) for k, p in C.JUNK.items()], other=repr('none'))} AS junk_reason FROM base"


@register(adapter, base)
def block_language(d):
    return "SELECT doc_id, seq, language FROM base"


@register(*CORE)
def document_language(d):
    return "SELECT doc_id, max(doc_language) AS doc_language FROM told GROUP BY doc_id"


@register(adapter, base)
def language_distribution(d):
    return "SELECT doc_id, language, cast(count(*) AS bigint) AS n FROM base GROUP BY doc_id, language"


@register(adapter, base, deduped)
def block_dedup(d):
    return "SELECT doc_id, seq, page, t AS text FROM uniq"


@register(adapter, base)
def repeated_effective(d):
    return """SELECT b.doc_id, b.seq, b.page, b.t AS text FROM base b LEFT JOIN
  (SELECT doc_id, lt FROM base GROUP BY doc_id, lt HAVING count(DISTINCT page) >= 3) r ON b.doc_id = r.doc_id AND b.lt = r.lt WHERE r.lt IS NULL OR b.wc > 10"""


@register(*CORE)
def font_statistics(d):
    return "SELECT doc_id, round(max(fa), 6) AS avg_font_size, max(fm) AS max_font_size, cast(max(n_blocks) AS bigint) AS n_blocks FROM uniq GROUP BY doc_id"


@register(adapter)
def font_percentiles(d):
    q = lambda p: d.pct("font_size", p)
    return f"""SELECT doc_id, round(a, 6) AS avg_size, p50, p75, p90, round(greatest(p90, a * {d.f(1.4)}), 6) AS h1, round(greatest(p75, a * {d.f(1.2)}), 6) AS h2, round(greatest(p50, a * {d.f(1.1)}), 6) AS h3, upper_median
  FROM (SELECT s.doc_id, avg(font_size) AS a, {q(.5)} AS p50, {q(.75)} AS p75, {q(.9)} AS p90, max(CASE WHEN rn = {d.idiv('n', '2')} + 1 THEN font_size END) AS upper_median
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY font_size, seq) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM blocks) s GROUP BY s.doc_id)"""


@register(adapter)
def document_statistics(d):
    q = lambda x, p: d.pct(x, p)
    return f"""SELECT doc_id, round(avg(font_size), 6) AS mean_size, round(stddev_pop(font_size), 6) AS std_size, min(font_size) AS min_size, max(font_size) AS max_size, {q('font_size', .25)} AS p25, {q('font_size', .5)} AS p50, {q('font_size', .75)} AS p75, {q('font_size', .9)} AS p90, {q('font_size', .95)} AS p95,
  min(x0) AS left_margin, {q('x0', .5)} AS typical_x, max(x1) AS page_width, max(y0) AS page_height, round(avg(x0), 6) AS x_mean, round(stddev_pop(x0), 6) AS x_std, max(y0) - min(y0) AS y_range, round(avg(cast(length(text) AS double)), 6) AS mean_length, round(stddev_pop(cast(length(text) AS double)), 6) AS std_length,
  cast(count(*) AS bigint) AS total_blocks, cast(count(DISTINCT page) AS bigint) AS pages FROM blocks GROUP BY doc_id"""


@register(adapter)
def page_statistics(d):
    q = lambda p: d.pct("font_size", p)
    return f"""SELECT doc_id, page, round(avg(font_size), 6) AS avg_size, round(stddev_pop(font_size), 6) AS std_size, {q(.25)} AS p25, {q(.5)} AS p50, {q(.75)} AS p75, {q(.9)} AS p90, {q(.95)} AS p95, min(x0) AS left_margin, round(avg(x0), 6) AS avg_x, round(stddev_pop(x0), 6) AS std_x FROM blocks GROUP BY doc_id, page"""


def pages(d):
    return f"""pages AS (SELECT *, min_y + page_h * {d.f(.15)} AS header_y, min_y + page_h * {d.f(.85)} AS footer_y FROM (SELECT doc_id, page, min(y0) AS min_y, max(y1) AS max_y, max(y1) - min(y0) AS page_h, count(*) AS n FROM blocks GROUP BY doc_id, page)),
multi AS (SELECT doc_id, count(*) AS n_pages FROM pages GROUP BY doc_id)"""


@register(adapter)
def page_layout(d):
    """All that layout analysis says of a page: sizes, margins, spacing and alignment."""
    return f"""SELECT doc_id, page, cast(count(*) AS bigint) AS n_blocks, round(avg(font_size), 6) AS avg_size, round(stddev_pop(font_size), 6) AS std_size, min(x0) AS left_margin, max(x1) AS right_edge, min(y0) AS top, max(y1) AS bottom, round(coalesce(avg(gap), {d.f(0)}), 6) AS line_spacing,
  CASE WHEN var_pop(x0) < {d.f(10)} THEN 'left' WHEN var_pop(x1) < {d.f(10)} THEN 'right' WHEN abs((avg(x0) + avg(x1)) / 2 - {d.f(306)}) < {d.f(61.2)} THEN 'center' ELSE 'justified' END AS alignment FROM (SELECT *, y0 - lag(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, seq) AS gap FROM blocks) z GROUP BY doc_id, page"""


@register(adapter, pages)
def page_structure(d):
    return "SELECT doc_id, page, min_y, max_y, page_h AS page_height, round(header_y, 6) AS header_threshold, round(footer_y, 6) AS footer_threshold, cast(n AS bigint) AS block_count FROM pages"


def regions(d):
    """Candidates of page numbers, headers, footers and repeated elements, on documents of three pages and more."""
    kinds = d.filt(d.arr(["CASE WHEN y0 <= header_y THEN 'header' END", "CASE WHEN y0 >= footer_y THEN 'footer' END"]), "x", "x IS NOT NULL")
    page = "PARTITION BY doc_id, page"
    return f"""on_page AS (SELECT *, min_y + page_h * {d.f(.15)} AS header_y, min_y + page_h * {d.f(.85)} AS footer_y, {is_likely_content('t', 'lt', 'wc', d)} AS likely FROM (SELECT *, max_y - min_y AS page_h FROM (SELECT *, min(y0) OVER ({page}) AS min_y, max(y1) OVER ({page}) AS max_y FROM (SELECT *, {d.n_distinct('page', 'doc_id')} AS n_pages FROM (SELECT /*+ REPARTITION(doc_id) */ * FROM base) z0) z1) z2) z3 WHERE n_pages >= 3),
numbers AS (SELECT doc_id, page, seq, lt, CASE WHEN y0 <= header_y THEN 'header' ELSE 'footer' END AS place FROM on_page WHERE {any_rx('lt', C.PAGE_NUMBERS, d)}),
candidates AS ({d.explode('doc_id, page, seq, lt, ws, kind', kinds, 'kind', '(SELECT * FROM on_page WHERE NOT likely) z4')}),
repeats AS (SELECT doc_id, substring(lt, 1, 20) AS head, cast(floor(y0 / greatest(page_h, {d.f(1)}) * 10) AS int) AS bucket, count(*) AS n, count(DISTINCT page) AS on_pages, max(n_pages) AS n_pages, min_by(t, seq) AS text_pattern FROM on_page WHERE length(t) >= 3 AND NOT likely
  GROUP BY doc_id, substring(lt, 1, 20), cast(floor(y0 / greatest(page_h, {d.f(1)}) * 10) AS int) HAVING count(*) >= 2)"""


REGIONS = [adapter, base, pages, regions]


@register(*REGIONS)
def page_numbers(d):
    return "SELECT doc_id, page, seq, lt AS text, place FROM numbers"


@register(*REGIONS)
def page_number_patterns(d):
    return "SELECT doc_id, lt AS text_pattern, cast(count(DISTINCT page) AS bigint) AS n_pages FROM numbers GROUP BY doc_id, lt HAVING count(DISTINCT page) >= 2"


@register(*REGIONS)
def header_footer_candidates(d):
    return "SELECT doc_id, page, seq, kind, lt AS text FROM candidates"


@register(*REGIONS)
def repeated_elements(d):
    return f"SELECT doc_id, head, bucket, cast(n AS bigint) AS n, cast(on_pages AS bigint) AS on_pages, round(cast(on_pages AS double) / n_pages, 6) AS repetition_rate, text_pattern FROM repeats WHERE cast(on_pages AS double) / n_pages >= {d.f(.7)}"


@register(*REGIONS)
def exact_header_groups(d):
    return f"""SELECT g.doc_id, g.kind, g.lt AS text_pattern, cast(g.n AS bigint) AS n_pages, round(cast(g.n AS double) / a.n, 6) AS repetition_rate FROM (SELECT doc_id, kind, lt, count(DISTINCT page) AS n FROM candidates GROUP BY doc_id, kind, lt) g
  JOIN (SELECT doc_id, kind, count(DISTINCT page) AS n FROM candidates GROUP BY doc_id, kind) a ON g.doc_id = a.doc_id AND g.kind = a.kind WHERE cast(g.n AS double) / a.n >= {d.f(.7)}"""


def similar(d: Spark, a: str, b: str) -> str:
    """Jaccard of the words of two texts, 0.8 at least where one holds the other; 0 where either is empty."""
    x, y = d.distinct(d.words(a)), d.distinct(d.words(b))
    j = jaccard(d, x, y)
    return f"CASE WHEN {a} = '' OR {b} = '' THEN {d.f(0)} WHEN contains({a}, {b}) OR contains({b}, {a}) THEN greatest({j}, {d.f(.8)}) ELSE {j} END"


def led(d: Spark) -> str:
    """groups(doc_id, kind, page, seq, lead): each header or footer candidate with the first text, in reading order, that
    it is similar to; and patterns(doc_id, kind, pattern, page) of all four kinds on the pages they hold for."""
    if d.name == "spark":
        texts = "transform(array_sort(collect_list(struct(page, seq, lt))), x -> x.lt)"
        fold = f"aggregate({texts}, cast(array() AS array<string>), (acc, x) -> CASE WHEN exists(acc, a -> a = x OR {similar(d, 'x', 'a')} >= {d.f(.8)}) THEN acc ELSE concat(acc, array(x)) END)"
    else:
        fold = f"list_reduce(list_transform(list(lt ORDER BY page, seq), lambda q: [q]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda a: a = y[1] OR {similar(d, 'y[1]', 'a')} >= {d.f(.8)})) > 0 THEN acc ELSE list_concat(acc, y) END)"
    lead = d.at(d.filt("ls", "a", f"a = lt OR {similar(d, 'lt', 'a')} >= {d.f(.8)}"), 1)
    return f"""leaders AS (SELECT doc_id, kind, {fold} AS ls, count(DISTINCT page) AS all_pages FROM candidates GROUP BY doc_id, kind),
groups AS (SELECT doc_id, kind, page, seq, all_pages, {lead} AS lead FROM (SELECT c.doc_id, c.kind, c.page, c.seq, c.lt, l.ls, l.all_pages FROM candidates c JOIN leaders l ON c.doc_id = l.doc_id AND c.kind = l.kind) z),
rated AS (SELECT *, cast(on_pages AS double) / all_pages AS rate FROM (SELECT *, {d.n_distinct('page', 'doc_id, kind, lead')} AS on_pages FROM groups) z),
regions_ AS (SELECT doc_id, kind, lead, max(on_pages) AS n, max(all_pages) AS all_pages FROM rated WHERE rate >= {d.f(.7)} GROUP BY doc_id, kind, lead),
patterns AS (SELECT DISTINCT doc_id, kind, lead AS pattern, page FROM rated WHERE rate >= {d.f(.7)}
  UNION ALL SELECT DISTINCT doc_id, 'page_number' AS kind, lt AS pattern, page FROM (SELECT *, {d.n_distinct('page', 'doc_id, lt')} AS k FROM numbers) z WHERE k >= 2
  UNION ALL SELECT DISTINCT doc_id, 'repeated_element' AS kind, lower(first_t) AS pattern, page FROM (SELECT doc_id, page, n_pages, count(*) OVER (PARTITION BY doc_id, head, bucket) AS n, {d.n_distinct('page', 'doc_id, head, bucket')} AS on_pages, first_value(t) OVER (PARTITION BY doc_id, head, bucket ORDER BY seq {WHOLE}) AS first_t
    FROM (SELECT *, substring(lt, 1, 20) AS head, cast(floor(y0 / greatest(page_h, {d.f(1)}) * 10) AS int) AS bucket FROM on_page WHERE length(t) >= 3 AND NOT likely) y) z WHERE n >= 2 AND cast(on_pages AS double) / n_pages >= {d.f(.7)}),
marked_out AS (SELECT b.doc_id, b.seq, min(p.kind) AS kind FROM base b JOIN patterns p ON b.doc_id = p.doc_id AND b.page = p.page AND {similar(d, 'b.lt', 'p.pattern')} >= {d.f(.8)} GROUP BY b.doc_id, b.seq)"""


@register(*REGIONS, led)
def header_footer_groups(d):
    return "SELECT doc_id, kind, lead AS text_pattern, cast(n AS bigint) AS n_pages, round(cast(n AS double) / all_pages, 6) AS repetition_rate FROM regions_"


@register(*REGIONS, led)
def header_footer_filter(d):
    """Blocks that match no pattern of their page: page numbers, headers, footers, repeated elements."""
    return "SELECT b.doc_id, b.seq, b.page, b.t AS text FROM base b LEFT JOIN marked_out m ON b.doc_id = m.doc_id AND b.seq = m.seq WHERE m.doc_id IS NULL"


@register(*REGIONS, led)
def filter_report(d):
    kinds = ("header", "footer", "page_number", "repeated_element")
    count = ", ".join(f"cast(coalesce(p.{k}, 0) AS bigint) AS {k}s" for k in kinds)
    each = ", ".join(f"count(DISTINCT CASE WHEN kind = '{k}' THEN pattern END) AS {k}" for k in kinds)
    return f"""SELECT a.doc_id, cast(a.n AS bigint) AS total_blocks, cast(coalesce(g.n, 0) AS bigint) AS blocks_filtered, {count}, round(cast(coalesce(g.n, 0) AS double) / a.n, 6) AS filter_rate FROM (SELECT doc_id, count(*) AS n FROM base GROUP BY doc_id) a
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM marked_out GROUP BY doc_id) g ON a.doc_id = g.doc_id LEFT JOIN (SELECT doc_id, {each} FROM patterns GROUP BY doc_id) p ON a.doc_id = p.doc_id"""


@register(*CORE, scored)
def heading_scores(d):
    return "SELECT doc_id, seq, page, score, level FROM scored"


@register(*CORE)
def section_headings(d):
    return f"SELECT doc_id, seq, page, {clean_heading('t', d)} AS text, level FROM (SELECT *, {section_level(d)} AS level FROM uniq) WHERE level IS NOT NULL"


@register(*HEADS)
def outline_headings(d):
    return f"SELECT doc_id, pos, {lvl(d)} AS level, text, page + 1 AS page FROM heads"


@register(*CORE, title)
def document_title(d):
    return "SELECT doc_id, title FROM titles"


@register(*CORE, all_rows)
def result_document(d):
    line = f"{lvl(d)} || '|' || htext || '|' || {num(d, 'page + 1')}"
    return f"SELECT doc_id, {title_text(d, 'kind = 0 AND page = 0')} AS title, coalesce({d.join(line, 'pos', '; ', 'head')}, '') AS outline, max(doc_language) AS detected_language, cast(max(n_blocks) AS bigint) AS total_blocks_analyzed FROM rows_ GROUP BY doc_id"


@register(*HEADS)
def result_validation(d):
    """The test of results, some of them spoilt: levels H1 to H3, pages from 1, texts there."""
    return f"""SELECT doc_id, cast(count(*) AS bigint) AS n, bool_and(level IN ('H1', 'H2', 'H3')) AS levels_valid, bool_and(page >= 1) AS pages_valid, bool_and(text <> '') AS texts_valid, bool_and(level IN ('H1', 'H2', 'H3') AND page >= 1 AND text <> '') AS valid
  FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 2 AND pos = 1 THEN 'H4' ELSE {lvl(d)} END AS level, CASE WHEN doc_id % 11 = 3 THEN page ELSE page + 1 END AS page, CASE WHEN doc_id % 13 = 5 AND pos = 2 THEN '' ELSE text END AS text FROM heads) z GROUP BY doc_id"""


@register(*HEADS)
def hierarchy_statistics(d):
    """Headings, adjustments and gaps fixed: a gap is a heading more than one level below the one before it as it came."""
    return """SELECT doc_id, cast(count(*) AS bigint) AS total_headings, cast(count_if(raw <> lv) AS bigint) AS level_adjustments, cast(count_if(coalesce(raw > before + 1, false)) AS bigint) AS gaps_fixed FROM (SELECT *, lag(lv) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM heads) z GROUP BY doc_id"""


@register(*HEADS)
def hierarchy_repair(d):
    return f"SELECT doc_id, pos, {lvl(d, 'raw')} AS original_level, {lvl(d)} AS level, raw <> lv AS hierarchy_adjusted, CASE WHEN lv < raw THEN 'promoted_to_maintain_hierarchy' ELSE 'no_change' END AS adjustment_reason FROM heads"


def parents(d):
    p = lambda k: f"max(CASE WHEN lv = {k} THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""parents AS (SELECT *, CASE WHEN lv = 2 THEN p1 WHEN lv = 3 THEN CASE WHEN p1 IS NULL THEN p2 WHEN p2 IS NULL THEN p1 ELSE greatest(p1, p2) END END AS parent FROM (SELECT *, {p(1)} AS p1, {p(2)} AS p2, lag(lv) OVER (PARTITION BY doc_id ORDER BY pos) AS prev, lag(page) OVER (PARTITION BY doc_id ORDER BY pos) AS prev_page FROM heads))"""


@register(*HEADS, parents)
def parent_headings(d):
    return "SELECT doc_id, pos, lv AS level, parent FROM parents"


@register(*HEADS, parents)
def level_transitions(d):
    return f"SELECT doc_id, pos, {lvl(d, 'prev')} AS from_level, {lvl(d)} AS to_level, page + 1 AS page, lv > prev + 1 AS skip, lv > prev + 1 OR prev > lv + 1 AS irregular FROM parents WHERE prev IS NOT NULL"


@register(*HEADS, parents)
def structure_issues(d):
    return f"""SELECT doc_id, cast(n AS bigint) AS n, cast(n1 AS bigint) AS h1, cast(n2 AS bigint) AS h2, cast(n3 AS bigint) AS h3, depth, n1 = 0 AS no_h1, n1 > n2 AND n2 > 0 AS too_many_h1, n3 > 3 * n2 AND n2 > 0 AS too_many_h3, n1 > n * {d.f(.5)} AS h1_majority, n3 > 5 * n2 AND n2 > 0 AS h3_excess, n1 > 1 AND n2 = 0 AS several_h1_no_h2, skips > 0 AS skipped
  FROM (SELECT doc_id, count(*) AS n, count_if(lv = 1) AS n1, count_if(lv = 2) AS n2, count_if(lv = 3) AS n3, max(lv) AS depth, count_if(coalesce(lv > prev + 1, false)) AS skips FROM parents GROUP BY doc_id)"""


@register(*HEADS)
def similarity_dedup(d):
    """First headings that no kept one equals or overlaps by more than 0.8 of the words; a fold in order."""
    j = jaccard(d, d.distinct(d.words("a")), d.distinct(d.words("x" if d.name == "spark" else "y[1]")))
    if d.name == "spark":
        texts = "transform(array_sort(collect_list(struct(pos, lower(trim(text)) AS t))), x -> x.t)"
        fold = f"aggregate({texts}, cast(array() AS array<string>), (acc, x) -> CASE WHEN exists(acc, a -> a = x OR {j} > {d.f(.8)}) THEN acc ELSE concat(acc, array(x)) END)"
    else:
        fold = f"list_reduce(list_transform(list(lower(trim(text)) ORDER BY pos), lambda q: [q]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda a: a = y[1] OR {j} > {d.f(.8)})) > 0 THEN acc ELSE list_concat(acc, y) END)"
    return f"SELECT doc_id, cast({d.size('kept')} AS bigint) AS n_kept, {'array_join' if d.name == 'spark' else 'array_to_string'}(kept, ' / ') AS kept FROM (SELECT doc_id, {fold} AS kept FROM heads GROUP BY doc_id)"


@register(*HEADS)
def merge_consecutive(d):
    """Headings of a page and level run together while the merged text is under 50 characters; a fold in order."""
    if d.name == "spark":
        rows = "transform(array_sort(collect_list(struct(pos, page, lv, text))), x -> struct(x.page AS page, x.lv AS lv, x.text AS text))"
        last = "element_at(acc, -1)"
        fold = f"aggregate({rows}, cast(array() AS array<struct<page:int,lv:int,text:string>>), (acc, x) -> CASE WHEN size(acc) > 0 AND try_element_at(acc, -1).page = x.page AND try_element_at(acc, -1).lv = x.lv AND length(try_element_at(acc, -1).text) < 50 THEN concat(slice(acc, 1, size(acc) - 1), array(struct({last}.page AS page, {last}.lv AS lv, {last}.text || ' ' || x.text AS text))) ELSE concat(acc, array(x)) END)"
        texts = "array_join(transform(m, x -> x.text), ' / ')"
    else:
        fold = "list_reduce(list_transform(list({'page': page, 'lv': lv, 'text': text} ORDER BY pos), lambda q: [q]), lambda acc, y: CASE WHEN acc[-1].page = y[1].page AND acc[-1].lv = y[1].lv AND length(acc[-1].text) < 50 THEN list_concat(acc[:-2], [{'page': acc[-1].page, 'lv': acc[-1].lv, 'text': acc[-1].text || ' ' || y[1].text}]) ELSE list_concat(acc, y) END)"
        texts = "array_to_string(list_transform(m, lambda x: x.text), ' / ')"
    return f"SELECT doc_id, cast({d.size('m')} AS bigint) AS n, {texts} AS texts FROM (SELECT doc_id, {fold} AS m FROM heads GROUP BY doc_id)"
