"""The pattern and word tables that results must agree on."""

MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
# Noise and form elements, on the text as it is.
FORM = [r"^\d+\.\s*$", r"^\d+\.\s*[A-Z][a-z\s]{3,50}$", r"^[A-Z][a-z\s]*:\s*$", r"^[A-Z][a-z\s]*:?\s*_+\s*$", r"^\d+\.\s+[A-Z\s]+\+\s+[A-Z\s]+$", r"^S\.No\s+Name\s+Age", r"^\d+\.\s+\d+\.\s+\d+\.", r"^Rs\.\s*$", r"^\d+\s+\d+\s*$", r"^date\s*$"]
# On the lower-cased text.
TOC = [r"\.{3,}.*\d+\s*$", r"^\d+\.\s*.+\s+\d+\s*$", r"^(revision\s+history|table\s+of\s+contents|acknowledgements|references).*\d+\s*$", r"^\d+\.\d+\s+.+\s+\d+\s*$"]
NOISE = [rf"^({MONTHS})\s+\d{{1,2}},?\s+\d{{4}}$", r"^total\s+annual\s+\$\d+m\s+\$\d+m$", rf"^({MONTHS})$", r"^\d+$", r"^page\s+\d+$", r"^\d+\s+of\s+\d+$", r"^copyright|^©\s*\d{4}", r"^\w+\.(com|org|net|edu)", r"^www\.", r"^version\s+[\d.]+", r"^march\s+\d{4}\s+\d+$"]
SIMPLE_NOISE = [r"^\.*$", r"^\.{3,}", r"^\d+$", r"^page \d+", r"^\d+ of \d+$", r"^copyright", r"^©", r"version \d{4}\s+page \d+", r"may \d+, \d{4}$", r"international software testing", r"^qualifications board", r"foundation level extension"]
SIMPLE_TOC = [r"revision history.*\d+$", r"table of contents.*\d+$", r"acknowledgements.*\d+$", r"introduction.*\d+$", r"references.*\d+$", r"\d+\.\d+.*\d+$", r"^\d+\.\s.*\d+$", r"\.{2,}.*\d+\s*$"]
LIKELY_NOISE = [r"^\d+$", r"^page \d+", r"^\d+ of \d+$", r"^copyright", r"^©", r"^all rights reserved", r"^\w+\.(com|org|net)", r"^printed on", r"^confidential"]
UNLIKELY = [r"^\d+$", r"^page \d+", r"^\d+ of \d+$", r"^copyright", r"^©", r"^\w+\.(com|org|net)"]
CONTENT_WORDS = ["the", "and", "of", "to", "in", "is", "that", "for", "with"]
JUNK = {
    "page_numbers": [r"^page\s+\d+$", r"^\d+\s+of\s+\d+$", r"^\d{1,3}$"],
    "headers_footers": [r"^copyright", r"^©\s*\d{4}", r"confidential", r"proprietary", r"all rights reserved", r"printed\s+(on|in)", r"published\s+by", r"version\s+[\d.]+", r"draft", r"^www\.", r"@[\w.]+\.[\w]+", r"https?://"],
    "document_metadata": [r"file\s*:\s*", r"author\s*:\s*", r"date\s*:\s*", r"modified\s*:\s*", r"created\s*:\s*", r"last\s+updated", r"revision\s+\d+"],
}
MAJOR = ["summary", "background", "timeline", "approach", "evaluation", "appendix"]
SECTION_WORDS = ["overview", "introduction", "background", "summary", "conclusion", "references", "acknowledgements", "contents", "history", "pathways", "options", "goals", "outcomes", "requirements", "structure", "current"]
SECTIONS = [(r"summary\s*$", "H2"), (r"background\s*$", "H2"), (r"timeline\s*:?\s*$", "H3"), (r"approach\s+and\s+specific", "H2"), (r"evaluation\s+and\s+awarding", "H2"), (r"appendix\s+[a-c]", "H2"), (r"^\d+\.\s+preamble", "H3"), (r"^\d+\.\s+terms\s+of\s+reference", "H3"), (r"^\d+\.\s+membership", "H3"), (r"^\d+\.\s+appointment\s+criteria", "H3"), (r"^\d+\.\s+term", "H3"), (r"^\d+\.\s+chair", "H3"), (r"^\d+\.\s+meetings", "H3"), (r"^\d+\.\s+lines\s+of\s+accountability", "H3"), (r"^\d+\.\s+financial\s+and\s+administrative", "H3")]
FORM_WORDS = ["name", "designation", "pay", "town", "amount"]
TITLE_WORDS = ["overview", "introduction", "guide", "manual", "report", "application", "form", "pathways", "program", "plan", "ontario", "digital", "library"]
SIMPLE_TITLE_WORDS = ["overview", "foundation", "level", "extensions", "guide", "manual"]
SIMPLE_HEADING_WORDS = ["introduction", "overview", "summary", "background", "conclusion", "requirements", "approach", "methodology", "references", "appendix", "acknowledgements", "history", "contents"]
SINGLE_HEADINGS = ["acknowledgements", "introduction", "overview", "summary", "background", "conclusion", "references", "appendix"]
# Pattern, level, confidence, weight of its category.
RULE_PATTERNS = [
    (r"^\s*\d+\.\s+", "H1", 0.8, 0.9),
    (r"^\s*\d+\.\d+\.\s+", "H2", 0.9, 0.9),
    (r"^\s*\d+\.\d+\.\d+\.\s+", "H3", 0.95, 0.9),
    (r"^\s*\d+\)\s+", "H2", 0.7, 0.9),
    (r"^\s*[a-z]\.\s+", "H2", 0.6, 0.9),
    (r"^\s*\([a-z]\)\s+", "H3", 0.6, 0.9),
    (r"^\s*chapter\s+\d+", "H1", 0.95, 1.0),
    (r"^\s*section\s+\d+", "H1", 0.85, 1.0),
    (r"^\s*part\s+\d+", "H1", 0.9, 1.0),
    (r"^\s*appendix\s*[a-z]?", "H1", 0.8, 1.0),
    (r"^\s*(introduction|overview|summary|conclusion)$", "H1", 0.8, 0.8),
    (r"^\s*(background|methodology|results|discussion)$", "H1", 0.7, 0.8),
    (r"^\s*(references|bibliography|acknowledgments)$", "H1", 0.9, 0.8),
    (r"^\s*(table of contents|index|glossary)$", "H1", 0.9, 0.8),
]
NUMBERING = [(r"^\d+\.\d+\.\d+\.?\s+", 2.0, "h3"), (r"^\d+\.\d+\.?\s+", 1.5, "h2"), (r"^\d+\.?\s+", 1.0, "h1"), (r"^[IVXivx]+\.?\s+", 1.0, "h1"), (r"^[A-Z]\.?\s+", 0.8, "h2"), (r"^\d+\)\s+", 0.8, "h2")]
PAGE_NUMBERS = [r"^\d+$", r"^page\s+\d+$", r"^\d+\s+of\s+\d+$", r"^-\s*\d+\s*-$", r"^\d+\s*/\s*\d+$"]
# Section patterns, name, level.
SECTION_PATTERNS = [(r"^\d+\.\s+", "decimal_1", 1), (r"^\d+\.\d+\.\s+", "decimal_2", 2), (r"^\d+\.\d+\.\d+\.\s+", "decimal_3", 3), (r"^\d+\)\s+", "paren_number", 1), (r"^[A-Z]\.\s+", "letter_dot", 1), (r"^\([a-z]\)\s+", "paren_letter", 2), (r"^[IVX]+\.\s+", "roman_dot", 1)]
VOCABULARY = {
    "academic": (["abstract", "introduction", "conclusion", "methodology", "results", "discussion", "references", "bibliography", "acknowledgments", "literature review", "related work", "future work", "limitations"], ["background", "overview", "summary", "analysis", "evaluation", "implementation", "experiment", "case study", "findings", "implications", "recommendations", "scope", "objectives"]),
    "technical": (["installation", "configuration", "setup", "requirements", "architecture", "design", "implementation", "api reference", "troubleshooting", "examples", "usage", "getting started"], ["features", "components", "modules", "system", "network", "database", "security", "performance", "testing", "deployment"]),
    "business": (["executive summary", "overview", "objectives", "strategy", "recommendations", "conclusion", "next steps", "action plan"], ["analysis", "market", "competition", "opportunities", "risks", "budget", "timeline", "resources", "metrics", "performance"]),
}
CONTENT_TYPES = {
    "question": ["what", "how", "why", "when", "where", "who", "which"],
    "instruction": ["step", "procedure", "process", "method", "approach"],
    "list": ["list", "items", "elements", "components", "parts"],
    "definition": ["definition", "meaning", "concept", "term", "explanation"],
    "example": ["example", "instance", "case", "illustration", "sample"],
    "comparison": ["versus", "vs", "compared", "difference", "similarity"],
}
ENHANCED_TYPES = {
    "question": [*CONTENT_TYPES["question"], "?"],
    "instruction": [*CONTENT_TYPES["instruction"], "install", "configure"],
    "list_header": [*CONTENT_TYPES["list"], "contents"],
    "definition": [*CONTENT_TYPES["definition"], "overview"],
    "example_section": [*CONTENT_TYPES["example"], "demo"],
    "comparison": [*CONTENT_TYPES["comparison"], "contrast"],
}
TECHNICAL = ["algorithm", "system", "method", "framework", "model", "architecture", "protocol", "interface", "implementation", "specification", "api", "database", "server", "client", "network", "security", "encryption", "authentication", "authorization", "configuration", "deployment"]
# Language: chapter markers, section patterns, native numbering, common headings.
MULTILINGUAL = {
    "japanese": (["第", "章", "節", "項", "編", "部"], [r"第\d+章", r"第\d+節", r"\d+\.\d+", r"第\d+項"], ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十"], ["概要", "序論", "結論", "参考文献", "謝辞", "付録"]),
    "chinese": (["第", "章", "节", "条", "篇", "部"], [r"第\d+章", r"第\d+节", r"\d+\.\d+"], ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十"], ["概述", "引言", "结论", "参考文献", "致谢", "附录"]),
    "french": (["chapitre", "section", "partie", "annexe"], [r"chapitre\s+\d+", r"section\s+\d+", r"\d+\.\d+"], [], ["introduction", "conclusion", "résumé", "références", "annexe"]),
    "german": (["kapitel", "abschnitt", "teil", "anhang"], [r"kapitel\s+\d+", r"abschnitt\s+\d+", r"\d+\.\d+"], [], ["einführung", "zusammenfassung", "schlussfolgerung", "literatur", "anhang"]),
    "spanish": (["capítulo", "sección", "parte", "anexo"], [r"capítulo\s+\d+", r"sección\s+\d+", r"\d+\.\d+"], [], ["introducción", "conclusión", "resumen", "referencias", "anexo"]),
}
# The English stop words of the usual list.
STOP_WORDS = ["i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now"]
HEADING_WORDS = ["introduction", "conclusion", "summary", "abstract", "overview", "background", "methodology", "method", "results", "discussion", "references", "bibliography", "appendix", "chapter", "section", "acknowledgments", "acknowledgements", "preface", "foreword", "glossary", "index", "contents", "objectives", "goals", "analysis", "findings", "recommendations", "implications", "literature", "review", "related", "work", "future", "limitations", "scope", "definition", "framework"]
GOOD_TITLE = ["analysis", "study", "report", "guide", "manual", "handbook", "overview", "introduction", "survey", "review", "proceedings", "annual", "quarterly", "white paper", "technical", "research", "comprehensive", "complete", "advanced", "practical", "essential"]
BAD_TITLE = ["page", "copyright", "©", "confidential", "draft", "version", "printed", "published", "author", "date", "file", "document"]
TITLE_PUNCTUATION = [(".", -0.2), (",", -0.1), (";", -0.3), (":", 0.1), ("?", -0.1), ("!", -0.2)]
TITLE_PATTERNS = [(r"^title[:\s]+(.+)", 0.9), (r"^(.+)\s*[-–—]\s*(?:report|study|analysis|guide|manual)", 0.8), (r"^(.+?)\s*\n\s*(?:a\s+)?(?:report|study|analysis)", 0.7), (r"^(.+?)\s*:\s*(?:an?\s+)?(?:overview|introduction|guide)", 0.6)]
SANS = ["arial", "helvetica", "calibri", "verdana"]
SERIF = ["times", "georgia", "garamond"]
STRATEGY_WEIGHTS = {"rules": 0.35, "fonts": 0.25, "semantics": 0.20, "layout": 0.15, "model": 0.05}
# Keys of the domain vocabularies, which stand where their terms should.
VOCABULARY_LEVELS = ["high_confidence", "medium_confidence"]
