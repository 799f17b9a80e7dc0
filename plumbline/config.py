"""Constants that decide results. Equal to those users of such a pipeline expect."""

from __future__ import annotations

#: Function words of the languages of the documents table.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "was", "for", "that", "with", "as", "on", "be", "by", "it", "this", "are", "from", "at", "or"),
    "de": ("der", "die", "und", "den", "mit", "von", "das", "des", "im", "ist", "nicht", "ein", "eine", "als", "auf", "dem", "zu", "in"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "sur", "au"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es"),
}
MIN_CHARS_PER_PAGE, PARTIAL_SHARE, FOREIGN_SHARE, BAD_RATIO, BORDERLINE_RATIO, MIN_TOKENS = 50, 0.3, 0.01, 0.03, 0.06, 50
#: Scripts that sound Turkish text never holds much of, as a character class.
FOREIGN_SCRIPTS = "[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\u0400-\u052f\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff]"

#: Near-duplicate texts: shingle words, least shingles, containment and length shares.
SHINGLE_WORDS, MIN_SHINGLES, EXCERPT_SHARE, SAME_TEXT_SHARE, SAME_LENGTH_SHARE = 5, 20, 0.5, 0.95, 0.9

RRF_K = 60
CANDIDATES_PER_RESULT, LEAST_CANDIDATES, MOST_CANDIDATES = 4, 50, 200

#: Chunk sizes in words.
SINGLE_CHUNK, WINDOW, OVERLAP, SECTION_MOST, SECTION_LEAST, ARTICLE_SINGLE, ARTICLE_WINDOW = 500, 200, 30, 300, 40, 350, 250
TOKENS_PER_WORD = 2.2

#: Extraction confidence: reasons in table order, each in its band; the band's penalty.
LOW_REASONS = (
    "missing_court", "missing_esas_no", "missing_karar_no", "missing_decision_date", "missing_chamber", "court_unmapped", "court_level_unmapped",
    "court_level_missing", "layout_unknown", "body_not_found", "text_summary_only", "duplicate_different_text", "duplicate_date_mismatch", "duplicate_of",
)
MEDIUM_REASONS = (
    "header_closing_date_mismatch", "karar_year_ne_date_year", "date_is_lower_court", "date_from_closing", "body_start_approximate", "statute_inferred_from_date",
    "statute_unmapped", "date_outside_issue_year", "multiple_esas_candidates", "duplicate_excerpt", "duplicate_same_text",
)
PENALTY = {"low": 60, "medium": 25}

FUZZY_DAYS, OUTLIER_YEARS, RETENTION_DAYS, RECHECK_DAYS = 3, 3, 30, 90
MONTHS = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")

#: Content types by file name extension.
EXTENSIONS = {
    "pdf": ("pdf",), "doc": ("doc",), "xls": ("xls",), "docx": ("docx",), "udf": ("udf",), "xlsx": ("xlsx_xlsm",), "xlsm": ("xlsx_xlsm",),
    "html": ("html",), "htm": ("html",), "txt": ("text",), "jpg": ("image",), "jpeg": ("image",), "png": ("image",), "tif": ("image",), "tiff": ("image",),
}
