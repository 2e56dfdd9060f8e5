"""Word lists, patterns and weights whose results must agree with those of the workbench being matched."""

# fixed values: token pattern, CJK range
TOKEN_PATTERN = r"[A-Za-z][A-Za-z0-9₂⁻−-]*|\d+(?:\.\d+)?|[\x{4e00}-\x{9fff}]+"
CJK_PATTERN = r"[\x{4e00}-\x{9fff}]"

# fixed values: retrieval weights and BM25 parameters
WEIGHTS = {"bm25": 0.45, "vector_similarity": 0.35, "term_coverage": 0.15, "section_prior": 0.05}
K1, B = 1.5, 0.75

# fixed values: section patterns, in order; captions
SECTIONS = (
    ("abstract", r"^(abstract|摘要)\b"),
    ("introduction", r"^(?:\d+(?:\.\d+)*\s*)?(introduction|引言|前言)\b"),
    ("methods", r"^(?:\d+(?:\.\d+)*\s*)?(materials?\s+and\s+methods?|methods?|方法|材料与方法|研究区|试验地)\b"),
    ("results", r"^(?:\d+(?:\.\d+)*\s*)?(results?|结果)\b"),
    ("discussion", r"^(?:\d+(?:\.\d+)*\s*)?(discussion|讨论)\b"),
    ("conclusion", r"^(?:\d+(?:\.\d+)*\s*)?(conclusions?|结论)\b"),
    ("references", r"^(references|literature cited|参考文献)\b"),
)
CAPTION_PATTERN = r"^(?:fig(?:ure)?\.?\s*\w+|图\s*\d+|table\s*\w+|表\s*\d+)"
TABLE_CAPTION_PATTERN = r"^(?:table|表)"
SECTION_TRIM = " ·•—–-"
SECTION_MAX = 100
LANGUAGE_CHARS = 20_000
FRONT = "front_matter"

# fixed values: screening patterns
UNIT_PATTERN = r"(?:µmol|μmol|umol|nmol|mmol|mg\s*co2|mgco2|°c|ºc|cm|mm|\bm\b|%|s[−-]?1|m[−-]?2)"
PREDICTION_PATTERN = r"\b(?:model(?:led|ed|ing)?|simulation|simulated|prediction|predicted)\b|(?:模型|模拟|预测)(?:值|结果|数据)?"
NUMBER_PATTERN = r"[-+]?\d+(?:[.,]\d+)?"
DOI_PATTERN = r"\b10\.\d{4,9}/[-._;()/:A-Z0-9]+"
YEAR_PATTERN = r"\b(?:19|20)\d{2}\b"
GENERIC_TITLES = ("", "untitled", "microsoft word", "acrobat distiller")

# fixed values: target fields (name, label, synonyms, unit)
TARGET_FIELDS = (
    ("stem_respiration_rate", "树干呼吸速率", ("树干呼吸", "树干co2通量", "树干co₂通量", "stem respiration", "stem co2 efflux", "stem co₂ efflux", "woody tissue respiration", "bole respiration"), "µmol CO₂ m⁻² s⁻¹"),
    ("measurement_temperature", "测量温度", ("测量温度", "树干温度", "气温", "measurement temperature", "stem temperature", "air temperature"), "°C"),
    ("diameter_at_breast_height", "胸径", ("胸径", "径级", "dbh", "diameter at breast height", "stem diameter"), "cm"),
)
# fixed values: context fields (name, label, synonyms)
CONTEXT_FIELDS = (
    ("species", "物种", ("物种", "树种", "species", "taxon")),
    ("sample_size", "样本量", ("样本量", "样本数", "sample size", "replicates", "number of trees", "n=")),
    ("site_name", "站点", ("站点", "样地", "研究区", "site", "plot", "study area")),
    ("latitude", "纬度", ("纬度", "经纬度", "latitude", "°n", "°s")),
    ("longitude", "经度", ("经度", "经纬度", "longitude", "°e", "°w")),
    ("measurement_method", "测量方法", ("测量方法", "呼吸室", "红外气体分析仪", "measurement method", "chamber", "infrared gas analyzer", "irga")),
    ("treatment", "处理方法", ("处理方法", "处理组", "treatment", "girdling", "fertilization")),
    ("observation_time", "观测时间", ("观测时间", "测量时间", "measurement date", "sampling period", "season")),
)
# fixed values: terms of fields that a specification doesn't name
FIELD_HINTS = {
    "species": ("物种", "树种", "species", "taxon", "scientific name"),
    "sample_size": ("样本量", "样本数", "sample size", "number of trees", "replicates", "n ="),
    "site_name": ("站点", "样地", "研究区", "site", "study area", "plot"),
    "latitude": ("纬度", "latitude", "coordinates", "°n", "°s"),
    "longitude": ("经度", "longitude", "coordinates", "°e", "°w"),
    "measurement_method": ("测量方法", "呼吸室", "红外气体分析仪", "measurement method", "chamber", "infrared gas analyzer", "irga"),
    "treatment": ("处理", "处理组", "treatment", "girdling", "fertilization"),
    "observation_time": ("观测时间", "测量时间", "measurement date", "sampling period", "season"),
}
# fixed values: sections where a field is expected, and the prior's three levels
EXPECTED_SECTIONS = {"sample_size": ("methods",), "site_name": ("methods",), "latitude": ("methods",), "longitude": ("methods",), "measurement_method": ("methods",), "observation_time": ("methods",)}
EXPECTED_DEFAULT = ("methods", "results")
PRIOR_SECTION, PRIOR_CAPTION, PRIOR_OTHER = 1.0, 0.65, 0.15
CAPTION_KINDS = ("figure_caption", "table_caption")

# fixed values: markers of the brief
REQUIRED_MARKERS = ("必须", "一定要", "至少要有", "必需", "required", "must have", "at least")
SOURCE_TERMS = {"text": ("正文", "文本", "text"), "table": ("表格", "表中", "table"), "figure": ("图中", "图件", "数据图", "figure", "chart", "plot")}
EXCLUSION_TERMS = {
    "model_prediction": ("不接受模型", "排除模型", "模型预测值不要", "no model"),
    "review_article": ("不接受综述", "排除综述", "no review article"),
    "citation_only": ("不接受引用数据", "排除引用", "original data only"),
}
CUSTOM_TARGET_PATTERN = r"(?:提取|需要|关注|研究)\s*([^，。；;]{2,40}?)(?:数据|变量|，|。|；|;)"
CUSTOM_LABEL, CUSTOM_FALLBACK = "用户自定义目标变量", "目标变量"
WARN_TARGET = "未匹配内置领域变量，请确认自定义目标变量和同义词。"
WARN_REQUIRED = "未识别到必须字段；系统暂时只按目标变量判断可用性。"

# fixed values: screening reasons
REASON_FAILED = "全文文本不足，当前解析结果不能支持可靠判断。"
REASON_TARGET = "目标术语证据块："
REASON_NUMERIC = "目标附近含数字/单位的证据块："
REASON_EXCLUDED = "按研究需求排除模型预测证据块："
REASON_USABLE = "存在明确目标数据，且必须上下文字段均有证据。"
REASON_RELATIVE = "存在目标数据，但缺少必须字段："
REASON_NODATA = "未发现满足当前规则的可提取目标数值证据。"

# fixed values: cache key and encoder identity; the cache key follows from them
CACHE_KEY_VERSION = "embedding-cache-key-v1"
CACHE_KEY_PARTS = ("cache_key_version", "document_sha256", "block_id", "normalized_text_sha256", "backend", "backend_version", "model", "model_version", "dimensions", "parameters_sha256")
HASHING_IDENTITY = {"backend": "hashing", "backend_version": "v1", "model": "blake2b-character-ngram", "model_version": "2-4gram-v1"}
DISABLED_IDENTITY = {"backend": "disabled", "backend_version": "v1", "model": "none", "model_version": "v1", "dimensions": 1, "is_neural": False}
VECTOR_DIMENSIONS, NGRAM_WIDTHS = 384, (2, 3, 4)
E5_MODEL, E5_REVISION = "intfloat/multilingual-e5-small", "614241f622f53c4eeff9890bdc4f31cfecc418b3"
E5_VERSIONS = {"sentence-transformers": "5.5.1", "transformers": "5.15.0", "torch": "2.13.0"}
E5_IDENTITY = {"backend": "sentence-transformers", "backend_version": "multilingual-e5-v1", "model": E5_MODEL, "model_version": E5_REVISION, "dimensions": VECTOR_DIMENSIONS, "is_neural": True}
E5_QUERY, E5_PASSAGE, E5_TOKENS = "query: ", "passage: ", 512

# fixed values: defaults of runs from before these were kept
RUN_DEFAULTS = {
    "backend": ("string", "unknown"), "backend_version": ("string", "unknown"), "model": ("string", "unknown"), "model_version": ("string", "unknown"),
    "parameters_json": ("string", "{}"), "query_count": ("int", 1), "total_blocks": ("long", 0), "elapsed_ms": ("double", 0.0),
    "cache_enabled": ("boolean", False), "cache_hits": ("long", 0), "cache_misses": ("long", 0), "cache_writes": ("long", 0),
}

# fixed values: shown texts
STATUS_LABELS = {"usable": "可用", "relative": "部分相关", "nodata": "无可提取数据", "failed": "解析失败"}
SUMMARY_FAILED = "共 %d 页，未读取到可靠文本层；需要 OCR 或人工处理后才能判断数据覆盖。"
SUMMARY_OK, SUMMARY_NO_FIELDS = "全文 %d 页、%d 个证据块；已定位 %s；识别到 %d 个图题、%d 个表题。", "暂无需求字段"
DELTA_OUTSIDE, DELTA_UP, DELTA_DOWN, DELTA_SAME = "BM25 Top K 外", "较 BM25 ↑", "较 BM25 ↓", "与 BM25 同位"
STRATEGY_LABELS = {"bm25-only": "BM25 only", "hashing-hybrid": "Hashing hybrid", "e5-hybrid": "E5 hybrid"}

# fixed values: words of a boolean setting
BOOLEAN_WORDS = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
