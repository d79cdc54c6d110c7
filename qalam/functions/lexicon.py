"""Word lists, patterns and constants.

FIXED VALUES. Everything in this module must equal the behaviour being
matched for results to agree; the lists are given as plain text, in their
natural order, and are not derived or transformed here.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: character classes (Unicode code point ranges).
# Written with \x{...} escapes, which both Java regex and RE2 accept.
# ---------------------------------------------------------------------------
# Arabic, Arabic Supplement, Arabic Extended-A, Presentation Forms A and B.
AR5 = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
# Arabic and Arabic Supplement only (the evaluator's notion of an Arabic char).
AR2 = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}"
# Arabic block only.
AR1 = r"\x{0600}-\x{06FF}"
# Diacritics counted by the evaluator.
HARAKAT = r"\x{064B}-\x{065F}"
# Diacritics removed by clean_text.
CLEAN_DIACRITICS = r"\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}"
# Diacritics and tatweel removed before dialect detection.
DETECT_DIACRITICS = r"\x{064B}-\x{0652}\x{0670}\x{0640}"
DETECT_DIACRITIC_CHARS = "".join(map(chr, range(0x064B, 0x0653))) + "\u0670\u0640"  # the same, one by one
# Python str.isspace() characters, i.e. what Python's \s and str.split() use.
WS = (r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Characters kept by clean_text(remove_special_chars=True) besides AR5 and WS.
CLEAN_KEEP_ASCII = r"a-zA-Z0-9.,!?;:()\[\]{}\"'\-"

# ---------------------------------------------------------------------------
# FIXED VALUES: letter folding.
# ---------------------------------------------------------------------------
ALEF_VARIANTS = "إأآا"      # all folded to bare alef ا
ALEF = "ا"
YEH_VARIANTS = "يى"         # folded to ي
YEH = "ي"
ALEF_MAKSURA = "ى"
TEH_MARBUTA = "ة"
HEH = "ه"
TEH = "ت"

# ---------------------------------------------------------------------------
# FIXED VALUES: dialect lexicon used by detect_dialect.
# Order of dialects is the tie-break order.
# Each entry: keywords (weight 2), patterns (regex, weight 1.5),
# negation words (1), question words (1), common phrases (3).
# ---------------------------------------------------------------------------
DIALECT_ORDER = ["egyptian", "levantine", "gulf", "maghrebi", "iraqi", "msa"]

DIALECT_FEATURES = {
    "egyptian": {
        "keywords": ["ازيك", "ايه", "كده", "علشان", "عايز", "عاوز", "بقى", "خلاص", "يلا"],
        "patterns": [r"ش\s+", r"مش\s+", r"ده\s+", r"دي\s+"],
        "negation_words": ["مش", "مبقاش", "مكانش"],
        "question_words": ["ايه", "فين", "امتى", "ازاي"],
        "common_phrases": ["ازيك", "اخبارك ايه", "كله تمام", "ربنا يخليك"],
    },
    "levantine": {
        "keywords": ["شو", "كيف", "هيك", "هاد", "هاي", "بدي", "بدك", "يعني", "شوي"],
        "patterns": [r"ما\s+.*ش", r"هاد\s+", r"هاي\s+", r"شو\s+"],
        "negation_words": ["ما", "مو", "مش"],
        "question_words": ["شو", "وين", "كيف", "ليش"],
        "common_phrases": ["كيفك", "شو اخبارك", "يعطيك العافية", "الله يعطيك العافية"],
    },
    "gulf": {
        "keywords": ["شلون", "وين", "شنو", "اشلون", "ابي", "ابغى", "زين", "مال", "شكو"],
        "patterns": [r"شلون\s+", r"وين\s+", r"شنو\s+", r"مال\s+"],
        "negation_words": ["ما", "مو", "مب"],
        "question_words": ["شلون", "وين", "شنو", "ليش"],
        "common_phrases": ["شلونك", "شنو اخبارك", "الله يعطيك العافية", "زين كذا"],
    },
    "maghrebi": {
        "keywords": ["كيفاش", "فين", "واش", "بغيت", "نتا", "نتي", "هاذا", "هاذي", "بزاف"],
        "patterns": [r"كيفاش\s+", r"واش\s+", r"هاذا\s+", r"هاذي\s+"],
        "negation_words": ["ما", "ماشي", "مكاين"],
        "question_words": ["كيفاش", "فين", "واش", "علاش"],
        "common_phrases": ["كيفاش راك", "واش اخبارك", "الله يعطيك الصحة", "بزاف مزيان"],
    },
    "iraqi": {
        "keywords": ["شلون", "شنو", "وين", "اريد", "اكو", "ماكو", "هسه", "شوكت"],
        "patterns": [r"شلون\s+", r"شنو\s+", r"اكو\s+", r"ماكو\s+"],
        "negation_words": ["ما", "مو", "ماكو"],
        "question_words": ["شلون", "شنو", "وين", "شوكت"],
        "common_phrases": ["شلونك", "شنو اخبارك", "الله يعطيك العافية", "اكو شي"],
    },
    "msa": {
        "keywords": ["كيف", "ماذا", "أين", "متى", "لماذا", "أريد", "أحتاج", "يجب"],
        "patterns": [r"لا\s+", r"ليس\s+", r"غير\s+", r"إن\s+"],
        "negation_words": ["لا", "ليس", "لم", "لن"],
        "question_words": ["كيف", "ماذا", "أين", "متى", "لماذا"],
        "common_phrases": ["كيف حالك", "ما أخبارك", "أشكرك جزيلا", "مع السلامة"],
    },
}

FEATURE_WEIGHTS = {
    "keywords": 2.0,
    "patterns": 1.5,
    "negation_words": 1.0,
    "question_words": 1.0,
    "common_phrases": 3.0,
}

DETECT_THRESHOLD = 0.3

# ---------------------------------------------------------------------------
# FIXED VALUES: dialect augmentation rules (D4). Only these three dialects
# have rules; any other target returns the text unchanged.
# ---------------------------------------------------------------------------
AUGMENT_RULES = {
    "egyptian": {
        "synonyms": {
            "كيف": ["ازاي", "ازيك"],
            "ماذا": ["ايه", "ايه ده"],
            "أين": ["فين"],
            "أريد": ["عايز", "عاوز"],
            "لا": ["مش", "لأ"],
            "نعم": ["ايوه", "اه"],
        },
        "transformations": [
            ("كيف", "ازاي"),
            ("ماذا", "ايه"),
            ("أين", "فين"),
            ("لا", "مش"),
        ],
    },
    "levantine": {
        "synonyms": {
            "كيف": ["شو", "كيف"],
            "ماذا": ["شو", "ايش"],
            "أين": ["وين"],
            "أريد": ["بدي", "بدك"],
            "لا": ["ما", "مو"],
            "هذا": ["هاد"],
            "هذه": ["هاي"],
        },
        "transformations": [
            ("كيف", "شو"),
            ("ماذا", "شو"),
            ("أين", "وين"),
            ("هذا", "هاد"),
            ("هذه", "هاي"),
        ],
    },
    "gulf": {
        "synonyms": {
            "كيف": ["شلون"],
            "ماذا": ["شنو"],
            "أين": ["وين"],
            "أريد": ["ابي", "ابغى"],
            "لا": ["ما", "مو"],
            "جيد": ["زين", "طيب"],
        },
        "transformations": [
            ("كيف", "شلون"),
            ("ماذا", "شنو"),
            ("أين", "وين"),
            ("أريد", "ابي"),
        ],
    },
}
AUGMENT_DIALECTS = ["egyptian", "levantine", "gulf"]
AUGMENT_RATIO = 0.3

# ---------------------------------------------------------------------------
# FIXED VALUES: evaluator patterns.
# ---------------------------------------------------------------------------
QUALITY_QUESTION_WORDS = ["ما", "كيف", "لماذا", "أين", "متى"]
EVAL_QUESTION_WORDS = ["ما", "كيف", "لماذا", "أين", "متى", "من", "ماذا", "هل"]
EVAL_FORMAL_INDICATORS = ["إن", "أن", "كان", "يكون", "سوف", "قد"]
EVAL_DIALECT_ORDER = ["egyptian", "gulf", "levantine", "maghrebi"]
EVAL_DIALECT_MARKERS = {
    "egyptian": ["ده", "دي", "إيه", "ازاي", "فين"],
    "gulf": ["شلون", "وين", "شنو", "هذا", "هذي"],
    "levantine": ["شو", "وين", "كيف", "هيك", "هاي"],
    "maghrebi": ["شنو", "فين", "كيفاش", "واش", "هاذ"],
}
RELIGIOUS_TERMS = ["الله", "النبي", "القرآن", "الإسلام", "المسجد", "الصلاة"]
COHERENCE_CONNECTORS = ["و", "لكن", "أيضا", "كما", "بالإضافة", "علاوة", "لذلك", "إذن"]
DOUBLE_ARTICLE = "الال"

# ---------------------------------------------------------------------------
# FIXED VALUES: instruction classification (C17), first match wins.
# ---------------------------------------------------------------------------
INSTRUCTION_TYPES = [
    ("question_answering", ["what", "how", "why", "when", "where", "who", r"\?"]),
    ("text_generation", ["write", "generate", "create", "compose", "draft"]),
    ("summarization", ["summarize", "summary", "brief", "outline"]),
    ("translation", ["translate", "translation", "convert"]),
    ("explanation", ["explain", "describe", "define", "clarify"]),
    ("analysis", ["analyze", "compare", "evaluate", "assess"]),
    ("classification", ["classify", "categorize", "identify", "label"]),
    ("reasoning", ["solve", "calculate", "reason", "logic"]),
]
TEMPLATE_ARTIFACTS = ["### instruction", "### response", "<|endoftext|>", "[INST]", "[/INST]"]

# Instruction / response extraction: field order and text patterns.
INSTRUCTION_FIELDS = ["instruction", "prompt", "input", "question", "query"]
RESPONSE_FIELDS = ["response", "output", "answer", "completion", "target"]
INSTRUCTION_PATTERNS = [
    r"### Instruction:\s*(.+?)\s*### Response:",
    r"Instruction:\s*(.+?)\s*Response:",
    r"Question:\s*(.+?)\s*Answer:",
    r"Input:\s*(.+?)\s*Output:",
]
RESPONSE_PATTERNS = [
    r"### Response:\s*(.+?)(?:### |$)",
    r"Response:\s*(.+?)(?:Instruction:|$)",
    r"Answer:\s*(.+?)(?:Question:|$)",
    r"Output:\s*(.+?)(?:Input:|$)",
]

# Binary label truth set (B8): value is 1 when it equals one of these.
TRUE_LABEL_STRINGS = ["1", "true", "desirable", "good"]

# SFT loader default template and response marker.
SFT_TEMPLATE = "### التعليمات:\n{instruction}\n\n### الإجابة:\n{response}"
SFT_RESPONSE_TEMPLATE = "### الإجابة:"
# Instruction-table builder default template.
CHATML_TEMPLATE = "<|im_start|>user\n{instruction}<|im_end|>\n<|im_start|>assistant\n{response}<|im_end|>"

# ---------------------------------------------------------------------------
# FIXED VALUES: general augmenter (D20): synonyms, paraphrase prefixes, rates.
# ---------------------------------------------------------------------------
GENERAL_SYNONYMS = {
    "كبير": ["ضخم", "عظيم", "هائل"],
    "صغير": ["ضئيل", "قليل", "محدود"],
    "جميل": ["رائع", "حسن", "بديع"],
    "سيء": ["رديء", "قبيح", "مؤذي"],
    "سريع": ["عاجل", "مستعجل", "فوري"],
    "بطيء": ["متأني", "هادئ", "متمهل"],
}
PARAPHRASE_TEMPLATES = [
    "بمعنى آخر، {x}",
    "يمكن القول أن {x}",
    "من الممكن أن نقول {x}",
    "بعبارة أخرى، {x}",
]
SYNONYM_PROB = 0.1
PARAPHRASE_PROB = 0.05
NOISE_PROB = 0.02

# ---------------------------------------------------------------------------
# FIXED VALUES: instruction templates by language (B24): (without input, with input).
# ---------------------------------------------------------------------------
INSTRUCTION_TEMPLATES = {
    "arabic": ("### التعليمات:\n{instruction}\n\n### الاستجابة:\n{output}",
               "### التعليمات:\n{instruction}\n\n### المدخلات:\n{input}\n\n### الاستجابة:\n{output}"),
    "english": ("### Instruction:\n{instruction}\n\n### Response:\n{output}",
                "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n{output}"),
    "mixed": ("### Instruction | التعليمات:\n{instruction}\n\n### Response | الاستجابة:\n{output}",
              "### Instruction | التعليمات:\n{instruction}\n\n### Input | المدخلات:\n{input}\n\n### Response | الاستجابة:\n{output}"),
}

# FIXED VALUES: QA templates.
QA_TEMPLATES = {
    "simple": "السؤال: {question}\nالإجابة: {answer}",
    "context": "السياق: {context}\n\nالسؤال: {question}\nالإجابة: {answer}",
    "structured": "### السؤال\n{question}\n\n### الإجابة\n{answer}",
    "conversation": "المستخدم: {question}\nالمساعد: {answer}",
}

# FIXED VALUES: alef and meem as they look when UTF-8 was read as a one-byte encoding.
MOJIBAKE = [("\u00d8\u00a7", "\u0627"), ("\u00d9\u2026", "\u0645")]

# FIXED VALUES: prompts of a question alone, with a context, and with options.
QUESTION_PROMPTS = {
    "plain": "السؤال: {question}\n\nالإجابة:",
    "context": "السياق: {context}\n\nالسؤال: {question}\n\nالإجابة:",
    "options": "السؤال: {question}\n\nالخيارات:\n{options}\n\nالإجابة:",
}

# FIXED VALUES: Arabic grade words (B10); anything else is bad.
GRADE_MAP = {"ممتاز": "good", "جيد جداً": "good", "جيد": "good", "مقبول": "bad", "ضعيف": "bad", "سيء": "bad"}
