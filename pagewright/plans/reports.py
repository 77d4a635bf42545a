"""Plans: previews, structure and hierarchy reports, as lines and as whole texts."""

from __future__ import annotations

from ..functions.dialect import Spark, cases
from .outline import HEADS, all_rows, CORE, lvl, num, parents, register, title_text

RULE = "=" * 60


def counts(d: Spark) -> str:
    """counts: headings of each document by level, as they came (a) and as repaired (b), their pages, adjustments and depth."""
    by = ", ".join(f"count_if(raw = {k}) AS a{k}, count_if(lv = {k}) AS b{k}" for k in (1, 2, 3))
    return f"counts AS (SELECT doc_id, count(*) AS n, {by}, count(DISTINCT page) AS on_pages, min(page) + 1 AS first_page, max(page) + 1 AS last_page, count_if(raw <> lv) AS adjusted, max(lv) AS depth, count_if(coalesce(lv > prev + 1, false)) AS skips, count_if(coalesce(raw > prev + 1, false)) AS gaps FROM parents GROUP BY doc_id)"


def cut(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) > {n} THEN substring({t}, 1, {n - 3}) || '...' ELSE {t} END"


def share(d: Spark, k: int) -> str:
    """Percent of the headings, to one place, as text."""
    tenth = f"cast(round(b{k} * {d.f(1000)} / n) AS int)"
    return f"{num(d, d.idiv(tenth, '10'))} || '.' || {num(d, f'{tenth} % 10')} || '%'"


PREVIEW = lambda d: f"repeat(' ', (lv - 1) * 2) || {lvl(d)} || ': ' || {cut('text', 80)} || ' (Page ' || {num(d, 'page + 1')} || ')'"
ANCHOR = lambda d: d.rep("replace(lower(text), ' ', '-')", r"[^\p{L}\p{N}-]")
TOC = lambda d: f"repeat('  ', lv - 1) || '- [' || text || '](#' || {ANCHOR(d)} || ') *(Page ' || {num(d, 'page + 1')} || ')*'"
BREAK = "(prev_page IS NULL OR prev_page <> page)"
STRUCTURE = lambda d: f"lpad({num(d, 'pos')}, greatest(2, cast(length({num(d, 'pos')}) AS int)), ' ') || '. ' || repeat('  ', lv - 1) || {lvl(d)} || ': ' || text || ' (p.' || {num(d, 'page + 1')} || ')' || CASE WHEN raw <> lv THEN ' [adjusted, was:' || {lvl(d, 'raw')} || ']' ELSE '' END"


@register(*HEADS)
def preview_lines(d):
    return f"SELECT doc_id, pos, {PREVIEW(d)} AS line FROM heads"


@register(*HEADS, parents)
def preview_markdown(d):
    return f"SELECT doc_id, pos, {TOC(d)} AS toc_line, {BREAK} AS page_break, repeat('#', lv + 2) || ' ' || text AS body_line FROM parents"


@register(*HEADS, parents)
def structure_report(d):
    return f"SELECT doc_id, pos, {STRUCTURE(d)} AS line FROM parents"


def lines(d: Spark, *xs: str) -> str:
    """Texts, each on its line; null where any is."""
    return f" || {d.nl} || ".join(xs)


def bodies(d: Spark) -> str:
    """bodies: the lines of each document's headings put together."""
    page = f"CASE WHEN {BREAK} THEN '### Page ' || {num(d, 'page + 1')} || {d.nl} ELSE '' END || repeat('#', lv + 2) || ' ' || text"
    move = f"'  ' || {lvl(d, 'prev')} || ' → ' || {lvl(d)} || ' (Page ' || {num(d, 'page + 1')} || ')'"
    # d.join parts by a pattern-free text; the line feed is put in afterwards.
    join = lambda x, where="": f"replace({d.join(x, 'pos', '<nl>', where)}, '<nl>', {d.nl})"
    return f"bodies AS (SELECT doc_id, {join(PREVIEW(d))} AS preview, {join(TOC(d))} AS toc, {join(page)} AS detail, {join(STRUCTURE(d))} AS structure, coalesce({join(move, 'prev IS NOT NULL AND pos <= 11')}, '') AS moves FROM parents GROUP BY doc_id)"


@register(*HEADS, parents, counts, bodies)
def preview_text(d):
    """The plain preview of a document but for its title line."""
    each = [f"'  H{k}: ' || {num(d, f'b{k}')}" for k in (1, 2, 3)]
    body = lines(d, f"'{RULE}'", "'OUTLINE PREVIEW'", f"'{RULE}'", "''", f"'Total Headings: ' || {num(d, 'n')}", "''", "'Heading Distribution:'", *each, "''", "'DOCUMENT OUTLINE:'", f"'{'-' * 40}'", "''", "preview", "''", f"'{RULE}'")
    return f"SELECT c.doc_id, {body} AS report FROM counts c JOIN bodies b ON c.doc_id = b.doc_id"


@register(*HEADS, parents, counts, bodies)
def markdown_text(d):
    each = [f"'- **H{k}:** ' || {num(d, f'b{k}')} || ' (' || {share(d, k)} || ')'" for k in (1, 2, 3)]
    body = lines(d, "'## Document Statistics'", "''", f"'- **Total Headings:** ' || {num(d, 'n')}", f"'- **Pages with Headings:** ' || {num(d, 'on_pages')}", f"'- **Page Range:** ' || {num(d, 'first_page')} || '-' || {num(d, 'last_page')}", "''", "'### Heading Distribution'", "''", *each, "''", "'## Table of Contents'", "''", "toc", "''", "'---'", "''", "'## Detailed Outline'", "''", "detail", "'---'")
    return f"SELECT c.doc_id, {body} AS report FROM counts c JOIN bodies b ON c.doc_id = b.doc_id"


ISSUES = [("b1 = 0", "no_h1_headings"), ("skips > 0", "level_skipping"), ("b1 > b2 AND b2 > 0", "too_many_h1"), ("b3 > 3 * b2 AND b2 > 0", "too_many_h3")]


def issues(d: Spark) -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in ISSUES) + ")"


@register(*HEADS, parents, counts, bodies)
def structure_text(d):
    """Depth, consistency, the first ten transitions, numbered lines and issues of a document."""
    more = f"CASE WHEN n > 11 THEN {d.nl} || '  ... and ' || {num(d, 'n - 11')} || ' more' ELSE '' END"
    body = lines(d, "'DOCUMENT STRUCTURE ANALYSIS'", f"'{'=' * 50}'", "''", "'HIERARCHY ANALYSIS:'", f"'Max Depth: ' || {num(d, 'depth')}", "'Hierarchy Consistency: ' || CASE WHEN skips = 0 THEN 'Good' ELSE 'Issues Found' END", "''", f"'LEVEL TRANSITIONS:' || {d.nl} || moves || {more}", "''", "'DETAILED STRUCTURE:'", "structure", "''", f"'ISSUES DETECTED: ' || {issues(d)}")
    return f"SELECT c.doc_id, {body} AS report FROM counts c JOIN bodies b ON c.doc_id = b.doc_id"


@register(*HEADS, parents, counts)
def hierarchy_report(d):
    """Counts and shares of the levels, adjustments, gaps fixed and issues, as columns and as a text."""
    each = [f"'  H{k}: ' || {num(d, f'b{k}')} || ' (' || {share(d, k)} || ')'" for k in (1, 2, 3)]
    body = lines(d, f"'Total headings processed: ' || {num(d, 'n')}", "'Level Distribution:'", *each, f"'Hierarchy adjustments made: ' || {num(d, 'adjusted')}", f"'Hierarchy gaps fixed: ' || {num(d, 'gaps')}", f"'Issues detected: ' || {issues(d)}", "CASE WHEN skips = 0 THEN 'Document has consistent hierarchy' ELSE 'Document has inconsistent hierarchy' END")
    return f"SELECT doc_id, cast(n AS bigint) AS n, {', '.join(f'cast(b{k} AS bigint) AS h{k}, round(b{k} * {d.f(100)} / n, 1) AS share_h{k}' for k in (1, 2, 3))}, cast(adjusted AS bigint) AS adjusted, cast(gaps AS bigint) AS gaps_fixed, {body} AS report FROM counts"


@register(*HEADS, parents)
def hierarchy_context(d):
    """The headings still open at the end of a document, outermost first: the last of each level after the last of those above."""
    last = ", ".join(f"max(CASE WHEN lv = {k} THEN pos END) AS l{k}" for k in (1, 2, 3))
    open_ = cases(("lv = 1", "pos = l1"), ("lv = 2", "pos = l2 AND pos > coalesce(l1, 0)"), other="pos = l3 AND pos > greatest(coalesce(l1, 0), coalesce(l2, 0))")
    return f"SELECT p.doc_id, p.pos, {lvl(d)} AS level, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS text, page + 1 AS page, cast(count(*) OVER (PARTITION BY p.doc_id) AS bigint) AS stack_depth FROM parents p JOIN (SELECT doc_id, {last} FROM parents GROUP BY doc_id) l ON p.doc_id = l.doc_id WHERE {open_}"


@register(*HEADS, parents, counts)
def quick_summary(d):
    part = lambda k: f"CASE WHEN b{k} > 0 THEN {num(d, f'b{k}')} || ' H{k}' END"
    return f"SELECT doc_id, concat_ws(', ', {part(1)}, {part(2)}, {part(3)}) || ' (' || {num(d, 'n')} || ' total)' AS summary FROM counts"


@register(*HEADS, parents, counts)
def comparison_report(d):
    change = lambda k: f"{num(d, f'a{k}')} || ' → ' || {num(d, f'b{k}')} AS h{k}, cast(b{k} - a{k} AS bigint) AS change_h{k}"
    return f"SELECT doc_id, {change(1)}, {change(2)}, {change(3)}, cast(adjusted AS bigint) AS n_adjusted FROM counts"


@register(*CORE, all_rows)
def titled_documents(d):
    """Title and number of headings of each document, also of one without headings."""
    return f"SELECT doc_id, {title_text(d, 'kind = 0 AND page = 0')} AS title, cast(count_if(head) AS bigint) AS n_headings FROM rows_ GROUP BY doc_id"
