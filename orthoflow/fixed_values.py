"""Values that decide results: patterns, word endings, limits, formats.

Everything here is a fixed value of the review rules.  Callers can pass their
own tables to the operators; these are the defaults.
"""

# --- Fixed values: text patterns (Java and RE2 compatible) -----------------
WORD = r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+(?:'[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+)?"
MAILTO = r"(?iU)\bmailto:[^\s<>\"']+"
EMAIL = r"(?iU)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
URL = r"(?iU)\b(?:https?://|www\.)[^\s<>\"']+"
DIACRITIC = r"[áéíóúüñÁÉÍÓÚÜÑ]"
TITLE_WORD = r"^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$"
UPPER_WORD = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"
APOSTROPHE_NAME = r"^[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]*'[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]+$"
MIXED_NAME = r"^\p{Lu}.*(\p{Lu}.*\p{Ll}|\p{Ll}.*\p{Lu})"
NUMBER_WORD = r"^\d+([.,]\d+)*$"
ACRONYM = r"^[A-ZÁÉÍÓÚÜÑ]{2,}\d*$"
ADDRESS_WORD = r"@|://|^www\."
LEXICON_WORD = r"^[A-Za-zÁÉÍÓÚÜÑáéíóúüñÇçÖö]+$"
LEXICON_WORD_HYPHEN = r"^[A-Za-zÁÉÍÓÚÜÑáéíóúüñÇçÖö]+(-[A-Za-zÁÉÍÓÚÜÑáéíóúüñÇçÖö]+)?$"
LEXICON_WORD_DIGITS = r"^[A-Za-z0-9ÁÉÍÓÚÜÑáéíóúüñÇçÖö]+$"
LOANWORD = r"^[A-Za-z0-9][A-Za-z0-9\-]*$"
RUN = r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)?"
PIECE = r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)?|[^\p{L}\p{N}_]+"

# --- Fixed values: review limits ------------------------------------------
MIN_WORD_LENGTH = 3
MAX_UPPER = 12
MAX_UPPER_OLDER = 8
MAX_DISTANCE = 2
MAX_SUGGESTIONS = 5
BATCH_SIZE = 40
DISCARDS_KEPT = 100
REASON_WORDS = 6
REASON_CHARS = 48
PATH_CHARS = 1000
LABEL_CHARS = 500
SPLIT_RUNS = 6
PREFIX_LENGTH = 4
NO_ANSWER = "sin respuesta"
NO_CONTENT = "archivo sin contenido"
NO_TEXT = "No se pudo extraer texto del archivo"

# --- Fixed values: file formats -------------------------------------------
CHECKED_FORMATS = ("doc", "docx", "xls", "xlsx", "ppt", "pptx", "pdf")
UPLOAD_FORMATS = (
    "pdf", "doc", "docx", "docm", "odt", "rtf", "xls", "xlsx", "xlsm", "ods", "csv",
    "ppt", "pptx", "pptm", "odp",
)

# --- Fixed values: endings that need an accent ----------------------------
BAD_ENDINGS = (
    "cion", "sion", "logia", "logias", "grafia", "grafias", "scopia", "scopias",
    "tomia", "tomias", "ectomia", "ectomias", "patia", "patias",
    "dinamica", "dinamico", "dinamicas", "dinamicos",
    "cinetica", "cinetico", "cineticas", "cineticos",
    "grafica", "grafico", "graficas", "graficos",
    "logica", "logico", "logicas", "logicos",
    "nomica", "nomico", "nomicas", "nomicos",
    "metrica", "metrico", "metricas", "metricos",
    "terapeutica", "terapeutico",
)
BAD_EXACT = ("algebra", "algebras", "exequatur", "analisis")
BAD_ENDINGS_LOANWORD = ("cion", "ciones", "sion", "siones", "logia", "logias")

# --- Fixed values: English words and endings ------------------------------
ENGLISH_ENDINGS = (
    "ing", "tion", "tions", "ness", "ment", "ments", "ship", "ships", "ally",
    "ized", "ised", "izing", "ising", "ology", "opathies",
)
ENGLISH_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "were", "was", "are",
    "been", "being", "have", "has", "had", "will", "would", "could", "should",
    "vaccine", "airway", "agenda", "extraction", "interaction", "interpretation",
    "intervention", "microsimulation", "substituting", "anticipating",
    "anticoagulation", "abscessos",
)

# --- Fixed values: gender, number and plural endings ----------------------
SAFE_ADJECTIVE_ENDINGS = ("ico", "ica", "ivo", "iva", "oso", "osa")
GENDER_PAIRS = (
    ("ico", "ica"), ("ivo", "iva"), ("oso", "osa"), ("ario", "aria"), ("orio", "oria"),
    ("ógico", "ógica"), ("áfico", "áfica"), ("ético", "ética"), ("ático", "ática"),
    ("ítico", "ítica"),
)
CLINICAL_GENDER_PAIRS = (
    ("ico", "ica"), ("ivo", "iva"), ("oso", "osa"), ("ario", "aria"), ("orio", "oria"),
    ("esco", "esca"), ("ífico", "ífica"), ("ifico", "ifica"), ("ático", "ática"),
    ("atico", "atica"), ("ógico", "ógica"), ("ogico", "ogica"), ("áfico", "áfica"),
    ("afico", "afica"), ("ámico", "ámica"), ("amico", "amica"), ("ético", "ética"),
    ("etico", "etica"),
)
ADVERB_ENDINGS = ("ica", "iva", "osa")
CLINICAL_PLURAL_SKIP = (
    "sis", "tis", "osis", "itis", "oma", "ema", "ura", "ion", "ión", "ia", "ía",
    "ez", "is", "us", "um",
)
COMMON_SUFFIXES = (
    "ación", "aciones", "ición", "iciones", "sión", "siones", "logía", "logías",
    "grafía", "grafías", "metría", "metrías", "patía", "patías", "scopía", "scopías",
    "tomía", "tomías", "ismo", "ismos", "ista", "istas", "idad", "idades",
    "ario", "aria", "arios", "arias", "orio", "oria", "orios", "orias",
    "ivo", "iva", "ivos", "ivas", "ico", "ica", "icos", "icas",
    "ógico", "ógica", "ógicos", "ógicas", "ente", "entes", "encia", "encias",
    "ura", "uras", "oso", "osa", "osos", "osas", "al", "ales", "ar", "ares",
    "able", "ables", "ible", "ibles", "mente", "ez", "eza", "ezas",
    "amiento", "amientos", "imiento", "imientos",
)

# --- Fixed values: letters composed before matching -----------------------
COMPOSED_LETTERS = "áéíóúüñÁÉÍÓÚÜÑ"

# --- Fixed values: second opinion -----------------------------------------
PROMPT_HEAD = (
    "Para cada palabra: indica si es error ortografico real (true) "
    "o palabra valida (false), mas un motivo muy corto. "
    "No propongas correcciones. Mismo orden.\n\n"
    "Palabras:\n"
)
MIN_BUDGET = 200
MAX_BUDGET = 800
BASE_BUDGET = 80
WORD_BUDGET = 28

# --- Fixed values: markup and encodings ------------------------------------
CHARACTER_REFERENCE = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
# The names of the signs 160 to 255 in their order, then those of XML.
LATIN_NAMES = (
    "nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute micro "
    "para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil "
    "Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times Oslash Ugrave "
    "Uacute Ucirc Uuml Yacute THORN szlig agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml "
    "igrave iacute icirc iuml eth ntilde ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute "
    "thorn yuml"
).split()
CHARACTER_NAMES = {
    **{name: chr(160 + i) for i, name in enumerate(LATIN_NAMES)},
    "quot": '"', "amp": "&", "lt": "<", "gt": ">", "apos": "'",
}
# Bytes 0x80 to 0x9F that Windows-1252 defines, and their signs.
WINDOWS_CODES = [c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
WINDOWS_SIGNS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
