"""Fixed values that results depend on: word lists, class names, labels, patterns."""

# --- fixed values: subjects, in their configured order -------------------------------
SUBJECTS = ["语文", "数学", "英语", "物理", "化学", "生物"]
UNKNOWN = "未知"
FAILED = "错误"

# --- fixed values: built-in keyword dictionary ---------------------------------------
DEFAULT_KEYWORDS = {
    "语文": ["诗歌", "散文", "文言文", "修辞", "作文", "标点", "鲁迅", "杜甫"],
    "数学": ["函数", "方程", "几何", "概率", "导数", "积分", "矩阵", "证明"],
    "英语": ["grammar", "vocabulary", "reading", "writing", "tense", "essay", "paragraph"],
    "物理": ["力", "加速度", "电场", "磁场", "电路", "能量", "动量", "量子"],
    "化学": ["元素", "分子", "反应", "化学式", "溶液", "酸碱", "有机", "实验"],
    "生物": ["细胞", "基因", "DNA", "蛋白质", "生态系统", "进化", "遗传", "酶"],
}

# --- fixed values: stop words --------------------------------------------------------
STOPWORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上",
    "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
    "chapter", "page", "ppt", "slide",
]
STOPWORDS_ENGLISH = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
]

# --- fixed values: one-line subject descriptions for the dictionary export ------------
SUBJECT_DESCRIPTIONS = {
    "语文": "语言文字、文学、修辞、写作",
    "数学": "数学公式、几何、代数、计算",
    "英语": "英语语法、词汇、阅读、写作",
    "物理": "物理定律、力学、电磁学、光学",
    "化学": "化学元素、反应、实验、分子",
    "生物": "生物学、细胞、遗传、生态系统",
}

# --- fixed values: deck suffixes, slide caps, result headers -------------------------
DECK_SUFFIXES = [".pptx", ".ppt", ".pptm"]
BATCH_SUFFIXES = [".pptx", ".ppt"]
SLIDES_DEFAULT = 50
SLIDES_CLASSIFY = 30
SLIDES_KEYWORD_ONLY = 10
IMAGES_PER_DECK = 10
RESULT_HEADER_ZH = ["文件路径", "学科", "置信度", "处理时间(秒)"]
RESULT_HEADER_EN = ["file", "subject", "confidence", "time"]

# --- fixed values: confidence bins, lower bound inclusive, upper bound exclusive ------
CONFIDENCE_BINS = [
    (0.0, 0.5, "<50%"),
    (0.5, 0.7, "50-70%"),
    (0.7, 0.8, "70-80%"),
    (0.8, 0.9, "80-90%"),
    (0.9, 1.0, "90-100%"),
]

# --- fixed values: character classes -------------------------------------------------
# Unicode word characters and whitespace spelled out, because the regex engines
# differ in what their shorthand classes cover.
WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CLASS = (
    r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same whitespace for Java patterns: one Unicode property test instead of many ranges.
SPACE = r"(?U:[\s\x1c-\x1f])"
SPACE_NOT_PLAIN = r"(?U:[\s\x1c-\x1f&&[^ ]])"
NOT_WORD_OR_SPACE = r"(?U:[^\p{L}\p{N}_\s\x1c-\x1f])"
HAN_CLASS = r"\x{4e00}-\x{9fff}"
PUNCT_CLASS = r".,!?;:\-()"
