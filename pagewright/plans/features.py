"""Plans: block lookup, the comprehensive and the classifier's feature rows, TF-IDF weights, imputation, augmentation."""

from __future__ import annotations

from ..functions.dialect import Spark, any_of, any_rx, cases
from . import constants as C
from .analysis import BY_PAGE, probability, rules, semantic, vocabulary_share
from .outline import BASE, WHOLE_BASE, adapter, font_name, span_flags, register


def flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1 ELSE 0 END"


def page_rows(d: Spark, src: str, out: str) -> str:
    """`out`: rows of src with their place on the page (idx) and all rows of the page, in order of y."""
    row = d.struct({"idx": "idx", "t": "t", "x0": "x0", "y0": "y0", "y1": "y1", "fs": "font_size"})
    return f"{out} AS (SELECT *, {d.collect(row)} OVER (PARTITION BY doc_id, page) AS rows_, count(*) OVER (PARTITION BY doc_id, page) AS on_page FROM (SELECT *, cast(row_number() OVER ({BY_PAGE}) - 1 AS int) AS idx FROM {src}) z)"


def found(d: Spark, near: str) -> str:
    """The place of the first row of the page that is near the block itself (r is that row)."""
    return d.least(d.tran(d.filt("rows_", "r", near), "r", "r.idx"))


def near(x: float) -> str:
    return f"abs(r.x0 - x0) < {x} AND abs(r.y0 - y0) < {x}"


def row_at(d: Spark, place: str, field: str) -> str:
    return d.at(d.tran(d.filt("rows_", "r", f"r.idx = {place}"), "r", f"r.{field}"), 1)


def around(d: Spark) -> str:
    """around: base with the lookups of itself on its page and the rows before and after the one found."""
    at = {"at5": found(d, near(5)), "at1": found(d, near(1)), "at_text": found(d, "r.t = t AND abs(r.y0 - y0) < 1")}
    sides = [f"{row_at(d, f'{k} {o} 1', f)} AS {n}_{f}{k[2:]}" for k in ("at5", "at1") for o, n in (("-", "prev"), ("+", "next")) for f in ("y0", "y1", "fs")]
    similar = d.size(d.filt("rows_", "r", "r.idx BETWEEN at5 - 3 AND at5 + 3 AND r.idx <> at5 AND abs(r.fs - font_size) <= 1"))
    return f"""{page_rows(d, "(SELECT /*+ REPARTITION(doc_id) */ * FROM base) q", "on_pages")},
looked AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in at.items())} FROM on_pages),
around AS (SELECT *, {', '.join(sides)}, {similar} AS similar_near FROM looked)"""


@register(*BASE, around)
def block_lookup(d):
    return "SELECT doc_id, seq, idx, at5 AS index_within_5, at1 AS index_within_1, at_text AS index_by_text FROM around"


@register(*BASE, around)
def context_features(d):
    zero = d.f(0)
    return f"""SELECT doc_id, seq, block_index, round(block_index / cast(total AS double), 6) AS relative_position, block_index = 0 AS is_first, block_index = total - 1 AS is_last, coalesce(y0 - prev_y15, {zero}) AS whitespace_before, coalesce(next_y05 - y1, {zero}) AS whitespace_after, coalesce(font_size - prev_fs5, {zero}) AS prev_diff, coalesce(next_fs5 - font_size, {zero}) AS next_diff, cast(similar_near AS int) AS similar_nearby
  FROM (SELECT *, cast(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS int) AS block_index, count(*) OVER (PARTITION BY doc_id) AS total FROM around) z"""


@register(*BASE, around)
def ml_context(d):
    zero = d.f(0)
    return f"SELECT doc_id, seq, coalesce(y0 - prev_y11, {zero}) AS prev_vertical_gap, coalesce(font_size - prev_fs1, {zero}) AS prev_font_size_diff, coalesce(next_y01 - y1, {zero}) AS next_vertical_gap, coalesce(next_fs1 - font_size, {zero}) AS next_font_size_diff, round(at1 / cast(on_page AS double), 6) AS relative_y_position FROM around"


def section(d: Spark) -> tuple[str, str]:
    """The section number at the head of a text, and its depth."""
    sec = f"coalesce(nullif({d.ext('t', r'^(\d+(?:\.\d+)*)')}, ''), nullif({d.ext('t', r'^([A-Z](?:\.\d+)*)')}, ''), '')"
    return sec, f"CASE WHEN {sec} = '' THEN 0 ELSE cast(least(length({sec}) - length(replace({sec}, '.', '')) + 1, 3) AS int) END"


def share(d: Spark, p: str) -> str:
    return f"CASE WHEN t = '' THEN {d.f(0)} ELSE round(cast(length({d.rep('t', p + '+')}) AS double) / length(t), 6) END"


@register(*BASE, around)
def ml_features(d):
    """The classifier's 35 columns."""
    w = "OVER (PARTITION BY doc_id)"
    zero = d.f(0)
    sec, depth = section(d)
    words = d.arr([d.s(x) for x in C.HEADING_WORDS])
    columns = {
        "font_size": "font_size", "font_size_ratio": f"round(font_size / avg(font_size) {w}, 6)", "font_size_zscore": f"CASE WHEN stddev_pop(font_size) {w} > 0 THEN round((font_size - avg(font_size) {w}) / stddev_pop(font_size) {w}, 6) ELSE {zero} END",
        "is_bold": flag("is_bold"), "is_italic": flag("is_italic"), "font_flags": f"cast({span_flags()} AS int)", "char_count": "cast(length(t) AS int)", "word_count": "wc", "avg_word_length": f"CASE WHEN wc = 0 THEN {zero} ELSE round(cast(length({d.rep('t', r'\s+')}) AS double) / wc, 6) END",
        "x_position": "x0", "y_position": "y0", "width": "x1 - x0", "height": "y1 - y0", "page_number": "page + 1",
        "starts_with_number": flag(d.rx("t", r"^\p{Nd}")), "has_colon": flag("contains(t, ':')"), "has_period": flag("contains(t, '.')"), "all_caps": flag("isup AND wc > 0"), "title_case": flag("ttl"), "ends_with_period": flag("right(t, 1) = '.'"), "starts_with_capital": flag(d.rx("t", r"^\p{Lu}")),
        "has_section_number": flag(f"{sec} <> ''"), "section_depth": depth, "has_common_words": flag(f"{d.size(d.both(d.words('lt'), words))} > 0"),
        "digit_ratio": share(d, r"[^\p{Nd}]"), "punct_ratio": share(d, r"[^.,;:!?]"), "space_ratio": share(d, r"[^\s]"),
        "font_size_percentile": "round(cume_dist() OVER (PARTITION BY doc_id ORDER BY font_size), 6)", "is_largest_font": flag(f"font_size = max(font_size) {w}"), "is_above_avg_font": flag(f"font_size > avg(font_size) {w}"),
        "prev_vertical_gap": f"coalesce(y0 - prev_y11, {zero})", "prev_font_size_diff": f"coalesce(font_size - prev_fs1, {zero})", "next_vertical_gap": f"coalesce(next_y01 - y1, {zero})", "next_font_size_diff": f"coalesce(next_fs1 - font_size, {zero})", "relative_y_position": "round(at1 / cast(on_page AS double), 6)",
    }
    return f"SELECT doc_id, seq, {', '.join(f'{x} AS {k}' for k, x in columns.items())} FROM around"


#: Which columns belong to which analysis; the later of two equal names stays.
NUMBERING = {"decimal_1": r"^\d+\.\s+", "decimal_2": r"^\d+\.\d+\.\s+", "decimal_3": r"^\d+\.\d+\.\d+\.\s+", "roman": r"^[ivx]+\.\s+", "letter": r"^[a-z]\.\s+", "paren_number": r"^\d+\)\s+", "paren_letter": r"^\([a-z]\)\s+"}


def analysed(d: Spark) -> str:
    """analysed: blocks with text and all that layout, rules and semantics say of them, in one chain over one scan."""
    p, w = "OVER (PARTITION BY doc_id, page)", "OVER (PARTITION BY doc_id)"
    kept = "doc_id, seq, page, idx, on_page, at5, t, lt, wc, ws, isup, ttl, language, font_size, is_bold, is_italic, x0, y0, x1, y1, prev_y15, next_y05, prev_fs5, next_fs5, similar_near, font_score, style_score, position_score, pattern_score, context_score, raw_score, confidence AS rule_confidence, is_heading AS rule_is_heading"
    return f"""{rules(d, "around")},
by_rules AS (SELECT {kept} FROM combined),
{semantic(d, "by_rules")},
{probability(d)},
analysed AS (SELECT *, avg(font_size) {w} AS f_mean, stddev_pop(font_size) {w} AS f_std, avg(x0) {w} AS x_mean, stddev_pop(x0) {w} AS x_std, min(x0) {w} AS x_min, count(*) {w} AS total, cast(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS int) AS block_index,
  avg(font_size) {p} AS pf_mean, stddev_pop(font_size) {p} AS pf_std, avg(x0) {p} AS px_mean, stddev_pop(x0) {p} AS px_std, min(x0) {p} AS px_min, cume_dist() OVER (PARTITION BY doc_id, page ORDER BY font_size) AS pf_rank, coalesce(avg(y0 - prev_y15) {p}, {d.f(0)}) AS line_gap,
  CASE WHEN var_pop(x0) {p} < {d.f(10)} THEN 'left' WHEN var_pop(x1) {p} < {d.f(10)} THEN 'right' WHEN abs((avg(x0) {p} + avg(x1) {p}) / 2 - {d.f(306)}) < {d.f(61.2)} THEN 'center' ELSE 'justified' END AS aligned FROM judged)"""


def feature_columns(d: Spark) -> dict[str, dict[str, str]]:
    """Columns of the comprehensive row by analysis."""
    zero, one = d.f(0), d.f(1)
    low = f"lower({font_name()})"
    depth = d.ext("t", r"^(\d+(?:\.\d+)*)")
    vocab = f"round({vocabulary_share(d)}, 6)"
    font = {
        "font_size": "font_size", "font_size_ratio": "round(font_size / f_mean, 6)", "font_size_zscore": f"CASE WHEN f_std > 0 THEN round((font_size - f_mean) / f_std, 6) ELSE {zero} END", "is_bold": flag("is_bold"), "is_italic": flag("is_italic"), "is_serif": flag(any_of(low, C.SERIF, d)), "is_sans_serif": flag(any_of(low, C.SANS, d)),
        "is_monospace": flag(f"(({span_flags()}) & 8) <> 0"), "font_flags": f"cast({span_flags()} AS int)", "is_display_font": flag(f"font_size > {d.f(18)}"), "is_title_font": flag(f"font_size > {d.f(14)} AND is_bold"),
    }
    position = {
        "x_position": "x0", "y_position": "y0", "width": "x1 - x0", "height": "y1 - y0", "x_position_zscore": f"CASE WHEN x_std > 0 THEN round((x0 - x_mean) / x_std, 6) ELSE {zero} END", "relative_x_position": zero, "aspect_ratio": f"CASE WHEN y1 > y0 THEN round((x1 - x0) / (y1 - y0), 6) ELSE {one} END",
        "is_centered": flag("aligned = 'center'"), "is_left_aligned": flag("aligned = 'left'"), "is_right_aligned": flag("aligned = 'right'"), "font_size_z_score": f"round((font_size - pf_mean) / greatest(pf_std, {d.f(.1)}), 6)", "font_size_percentile": "round(pf_rank, 6)", "x_position_z_score": f"round((x0 - px_mean) / greatest(px_std, {d.f(.1)}), 6)",
    }
    text = {
        "char_count": "char_count", "word_count": "wc", "sentence_count": "sentence_count", "avg_word_length": "round(avg_word_length, 6)", "alpha_ratio": "alpha_ratio", "digit_ratio": "digit_ratio", "punct_ratio": "punct_ratio", "space_ratio": "space_ratio", "upper_ratio": "upper_ratio", "stop_word_ratio": "round(stop_ratio, 6)",
        "first_word_capitalized": flag("first_cap"), "all_words_capitalized": flag("all_cap_words"), "title_case": flag("ttl"), "all_caps": flag("isup"), "language_english": flag("lang = 'english'"), "language_score": f"CASE WHEN lang = 'english' THEN {one} ELSE {d.f(.5)} END",
    }
    pattern = {
        **{f"has_{k}": flag(d.rx("lt", p)) for k, p in NUMBERING.items()}, "has_any_numbering": flag(any_rx("lt", list(NUMBERING.values()), d)), "section_depth": f"CASE WHEN {depth} = '' THEN 0 ELSE cast(least(length({depth}) - length(replace({depth}, '.', '')) + 1, 3) AS int) END",
        "starts_with_number": flag(d.rx("t", r"^\p{Nd}")), "starts_with_letter": flag(d.rx("t", r"^\p{L}")), "starts_with_capital": flag(d.rx("t", r"^\p{Lu}")), "ends_with_colon": flag("right(t, 1) = ':'"), "ends_with_period": flag("right(t, 1) = '.'"), "has_question_mark": flag("contains(t, '?')"), "has_parentheses": flag("contains(t, '(') AND contains(t, ')')"), "has_acronyms": flag("has_acronyms"),
    }
    semantics = {
        "heading_probability": "probability", "semantic_confidence": "confidence", "max_vocabulary_score": vocab, "academic_vocab_score": vocab, "technical_vocab_score": vocab, "business_vocab_score": vocab, "legal_vocab_score": zero, "has_heading_keywords": "0", "has_proper_nouns": flag("has_proper"), "has_technical_terms": flag("has_technical"),
        "is_question": flag("is_question"), "is_instruction": flag("is_instruction"), "is_definition": flag("is_definition"),
    }
    layout = {"line_spacing": "round(line_gap, 6)", "character_spacing": zero, "indentation_level": f"greatest({zero}, x0 - px_min)", "distance_from_left_margin": "x0 - px_min", "context_calculated": "1"}
    context = {
        "block_index": "block_index", "relative_position": "round(block_index / cast(total AS double), 6)", "is_first_block": flag("block_index = 0"), "is_last_block": flag("block_index = total - 1"), "whitespace_before": f"coalesce(y0 - prev_y15, {zero})", "whitespace_after": f"coalesce(next_y05 - y1, {zero})",
        "similar_font_blocks_nearby": "cast(similar_near AS int)", "prev_block_font_size_diff": f"coalesce(font_size - prev_fs5, {zero})", "next_block_font_size_diff": f"coalesce(next_fs5 - font_size, {zero})",
    }
    by_rule = {"rule_is_heading": flag("rule_is_heading"), "rule_confidence": "round(rule_confidence, 6)", "rule_raw_score": "round(raw_score, 6)", **{f"rule_{k}_score": f"round({k}_score, 6)" for k in ("font", "pattern", "position", "style", "context")}}
    model = {"ml_heading_probability": zero, "ml_confidence": zero}  # as without a trained model; models.with_probability fills them
    return {"font": font, "position": position, "text": text, "pattern": pattern, "semantic": semantics, "layout": layout, "context": context, "rule": by_rule, "model": model}


@register(*WHOLE_BASE, around, analysed)
def comprehensive_features(d):
    """94 columns of each block with text."""
    columns = {k: x for group in feature_columns(d).values() for k, x in group.items()}
    return f"SELECT doc_id, seq, {', '.join(f'{x} AS {k}' for k, x in columns.items())} FROM analysed"


def terms(d: Spark) -> str:
    """terms(doc_id, seq, w): single words without stop words, and pairs of neighbours among them."""
    toks = d.filt(d.split("lt", r"[^a-z0-9]+"), "w", f"{d.rx('w', '^[a-z]')} AND NOT {d.among('w', C.STOP_WORDS)}")
    pairs = d.either_all("toks", d.tran(d.seq("1", f"{d.size('toks')} - 1"), "i", f"{d.at('toks', 'i')} || ' ' || {d.at('toks', 'i + 1')}"))
    pairs = f"CASE WHEN {d.size('toks')} > 1 THEN {pairs} ELSE toks END"
    return f"counted_blocks AS (SELECT doc_id, seq, {pairs} AS grams, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, seq, {toks} AS toks FROM base) z),\nterms AS ({d.explode('doc_id, seq, n, w', 'grams', 'w', 'counted_blocks')})"


def weights(d: Spark) -> str:
    """weights(doc_id, seq, w, tf, df, idf, weight): of at most 100 terms of a document (the most frequent, then by
    name), in two blocks or more and at most 0.8 of them; weights of a block have length 1."""
    return f"""tfs AS (SELECT doc_id, seq, w, max(n) AS n, count(*) AS tf FROM terms GROUP BY doc_id, seq, w),
dfs AS (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS df, sum(tf) OVER (PARTITION BY doc_id, w) AS all_tf FROM tfs),
tops AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY all_tf DESC, w) AS place FROM dfs WHERE df >= 2 AND df <= {d.f(.8)} * n),
idfs AS (SELECT *, ln((1 + cast(n AS double)) / (1 + df)) + 1 AS idf FROM tops WHERE place <= 100),
weights AS (SELECT *, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id, seq)) AS weight FROM idfs)"""


@register(*BASE, terms, weights)
def tfidf_terms(d):
    return "SELECT doc_id, w AS term, cast(max(df) AS bigint) AS df, cast(sum(tf) AS bigint) AS tf, round(max(idf), 6) AS idf FROM weights GROUP BY doc_id, w"


@register(*BASE, terms, weights)
def tfidf_weights(d):
    return "SELECT doc_id, seq, w AS term, cast(tf AS bigint) AS tf, round(weight, 6) AS weight FROM weights"


@register(adapter)
def imputed_values(d):
    """Missing numbers become the document's median, other values its mode (the smallest of the most frequent)."""
    size, name = "CASE WHEN seq % 4 = 1 THEN NULL ELSE font_size END", f"CASE WHEN seq % 5 = 2 THEN NULL ELSE {font_name()} END"
    return f"""SELECT b.doc_id, b.seq, coalesce(b.size, m.med) AS font_size, coalesce(b.name, o.name) AS font_name FROM (SELECT doc_id, seq, {size} AS size, {name} AS name FROM blocks) b JOIN (SELECT doc_id, {d.pct(size, .5)} AS med FROM blocks GROUP BY doc_id) m ON b.doc_id = m.doc_id
  LEFT JOIN (SELECT doc_id, name FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, name) AS rn FROM (SELECT doc_id, {name} AS name FROM blocks) z WHERE name IS NOT NULL GROUP BY doc_id, name) z WHERE rn = 1) o ON b.doc_id = o.doc_id"""


@register(adapter)
def augmented_samples(d):
    """Two variations at most of each heading, the first that apply: upper case, title case, a size more or less, x moved."""
    up, ttl = "upper(replace(text, 'ß', 'ss'))", d.titled("text")
    rows = [("'upper'", f"{up} <> text", up, "font_size", "x0"), ("'title'", f"{ttl} <> text", ttl, "font_size", "x0"), ("'larger'", "true", "text", "font_size + 1", "x0"), ("'smaller'", "font_size > 1", "text", "font_size - 1", "x0"), ("'right'", "true", "text", "font_size", "x0 + 20"), ("'left'", "x0 >= 20", "text", "font_size", "x0 - 20")]
    kinds = d.filt(d.arr([f"CASE WHEN {r[1]} THEN {i} END" for i, r in enumerate(rows)]), "k", "k IS NOT NULL")
    two = d.filt(d.arr([d.at("kinds", 1), d.at("kinds", 2)]), "k", "k IS NOT NULL")
    each = d.explode("doc_id, seq, text, font_size, x0, k", two, "k", f"(SELECT *, {kinds} AS kinds FROM blocks WHERE font_size >= {d.f(16)})")
    pick = lambda n: cases(*[(f"k = {i}", r[n]) for i, r in enumerate(rows)])
    return f"SELECT doc_id, seq, {pick(0)} AS variation, {pick(2)} AS text, {pick(3)} AS font_size, {pick(4)} AS x0 FROM ({each}) z"
