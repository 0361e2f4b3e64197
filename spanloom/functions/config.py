"""Default word lists; every operator takes them as parameters."""

# Words that a span loses at its start.
LEADING_TRIM = (
    "the", "a", "an",
    "and", "or", "in", "on", "at", "to", "for", "with", "by", "of",
    "processing", "installing", "configuring", "managing", "troubleshooting", "encoding", "updating", "handling", "assisting", "performing", "conducting",
)
# Words that a span loses at its end.
TRAILING_TRIM = (
    "is", "was", "are", "were", "be", "been", "being",
    "the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "with", "by", "of",
)
# Fixed value: marks that don't count when a span's end words are looked up.
TRIM_MARKS = ".,:;!?()'\""
# Words that mark a second-label surface when generated text names no label.
SECOND_LABEL_WORDS = ("file", "filing", "excel", "document", "sheet", "record", "encode", "encoding", "inventory", "photocopy", "photocopying", "clerical", "office", "data entry")
# Names under which generated records and their parts may come.
RECORD_KEYS = ("sentences", "records", "data", "entries", "items", "results", "journal_entries")
SURFACE_KEYS = ("text", "entity", "term", "name", "surface", "value", "word")
LABEL_KEYS = ("label", "type", "category", "entity_type")
