"""The word lists, patterns and labels that decide results.  They must stay as they are."""

# ---- routing: a question belongs to a route if its lower-case text contains one of these
REFERENCE_MARKERS = ("参考文献", "引用了谁", "引用了哪些", "引文", "cite", "cited", "references", "reference list")
METADATA_MARKERS = (
    "author:", "title:", "venue:", "year:", "source:", "keyword:", "作者", "年份", "期刊", "会议", "题目", "标题", "出处",
    "作者是谁", "哪一年", "发表于", "发表在", "题目是什么", "标题是什么", "venue", "metadata",
    "谁提出", "谁发明", "由谁提出", "是谁提出", "哪篇论文提出", "首次提出", "who proposed", "proposed by",
    "who introduced", "introduced by", "which paper proposed",
)
SURVEY_MARKERS = (
    "发展路径", "发展脉络", "发展历程", "研究现状", "综述", "总体情况", "有哪些方向", "有哪些方法", "主要方法", "演进",
    "趋势", "survey", "overview", "state of the art", "landscape", "roadmap", "history", "trend",
)
COMPARISON_MARKERS = ("比较", "对比", "区别", "差异", "异同", "共同点", "compare", "comparison", "difference", "vs")
CONNECTOR = r"(?i)(和|与|及|以及|跟|vs\.?|/|、|&|\band\b)"
MODEL_LIKE = r"[A-Za-z][A-Za-z0-9._+-]{1,30}"
REFERENCE_SCOPES = ("references", "reference", "ref", "refs")

# ---- rewriting
ZH_TO_EN = {
    "综述": "survey review overview", "总结": "summary overview", "方法": "method approach", "模型": "model architecture",
    "算法": "algorithm method", "实验": "experiment evaluation", "结果": "results performance", "性能": "performance results",
    "指标": "metrics score", "数据集": "dataset benchmark", "基准": "benchmark evaluation", "训练": "training optimization",
    "推理": "inference decoding", "多模态": "multimodal", "视觉": "vision visual", "图像": "image visual",
    "文本": "text language", "检索": "retrieval search", "重排序": "rerank reranking", "问答": "question answering qa",
    "生成": "generation generative", "知识库": "knowledge base", "医学": "medical biomedical", "临床": "clinical medical",
    "药物": "drug molecule", "蛋白": "protein biology", "基因": "gene genomics", "消融": "ablation study",
    "局限": "limitation weakness", "贡献": "contribution novelty",
}
EN_TO_ZH = {
    "survey": "综述", "review": "综述", "overview": "综述", "method": "方法", "approach": "方法", "model": "模型",
    "architecture": "模型", "algorithm": "算法", "experiment": "实验", "evaluation": "评测", "result": "结果",
    "results": "结果", "performance": "性能", "metric": "指标", "metrics": "指标", "dataset": "数据集", "benchmark": "基准",
    "training": "训练", "inference": "推理", "multimodal": "多模态", "vision": "视觉", "visual": "视觉", "image": "图像",
    "text": "文本", "retrieval": "检索", "search": "检索", "rerank": "重排序", "reranking": "重排序",
    "question answering": "问答", "qa": "问答", "generation": "生成", "knowledge base": "知识库", "medical": "医学",
    "biomedical": "医学", "clinical": "临床", "drug": "药物", "molecule": "药物", "protein": "蛋白", "gene": "基因",
    "ablation": "消融", "limitation": "局限", "contribution": "贡献", "novelty": "创新点",
}
ACRONYMS = {
    "rag": "retrieval augmented generation", "llm": "large language model", "nlp": "natural language processing",
    "cv": "computer vision", "vqa": "visual question answering", "qa": "question answering", "kg": "knowledge graph",
    "gnn": "graph neural network", "mlm": "masked language modeling", "asr": "automatic speech recognition",
}
ALIASES = {
    "resnet": "deep residual learning for image recognition residual network kaiming he xiangyu zhang shaoqing ren jian sun",
    "残差网络": "deep residual learning for image recognition resnet kaiming he xiangyu zhang shaoqing ren jian sun",
    "resnext": "aggregated residual transformations for deep neural networks saining xie ross girshick piotr dollar zhuowen tu kaiming he",
    "transformer": "attention is all you need ashish vaswani noam shazeer niki parmar jakob uszkoreit llion jones",
    "inception": "going deeper with convolutions christian szegedy wei liu yangqing jia pierre sermanet",
    "efficientnet": "efficientnet rethinking model scaling for convolutional neural networks mingxing tan quoc v le",
    "alexnet": "imagenet classification with deep convolutional neural networks alex krizhevsky ilya sutskever geoffrey hinton",
    "senet": "squeeze-and-excitation networks jie hu li shen gang sun",
    "se-net": "squeeze-and-excitation networks jie hu li shen gang sun",
    "eca-net": "eca-net efficient channel attention for deep convolutional neural networks qilong wang banggu wu",
    "normface": "normface l2 hypersphere embedding for face verification jian cheng feng wang alan loddon yuille",
}
TITLE_HINTS = {
    "resnet": "deep residual learning for image recognition",
    "残差网络": "deep residual learning for image recognition",
    "resnext": "aggregated residual transformations for deep neural networks",
    "transformer": "attention is all you need",
    "inception": "going deeper with convolutions",
    "efficientnet": "efficientnet: rethinking model scaling for convolutional neural networks",
    "alexnet": "imagenet classification with deep convolutional neural networks",
    "senet": "squeeze-and-excitation networks",
    "se-net": "squeeze-and-excitation networks",
    "eca-net": "eca-net efficient channel attention for deep convolutional neural networks",
    "normface": "normface: l2 hypersphere embedding for face verification",
}
INTENTS = (
    (("方法", "模型", "架构", "原理", "how", "method", "approach", "architecture"), "method approach architecture framework pipeline"),
    (("评测", "指标", "实验", "结果", "性能", "dataset", "benchmark", "metric", "evaluation", "result", "performance"), "dataset benchmark evaluation metrics results performance"),
    (("综述", "总结", "贡献", "创新", "overview", "summary", "contribution", "novelty"), "overview summary contribution novelty motivation"),
    (("局限", "缺点", "消融", "ablation", "limitation", "weakness", "failure"), "ablation limitation weakness failure case analysis"),
)
STOPWORDS = ("a", "an", "and", "are", "can", "could", "do", "does", "for", "how", "i", "in", "is", "it", "me", "of", "on", "please", "show", "tell", "the", "to", "used", "uses", "using", "what", "which")
FILLERS = ("请问", "帮我", "告诉我", "介绍下", "介绍一下", "解释下", "解释一下", "看看", "这个", "这篇", "论文", "文章", "一下", "一下子", "哪些", "什么", "怎么", "如何", "一下吧")
BOILERPLATE = (
    r"(?i)^(?:请问|请帮我|帮我|麻烦你|麻烦|可以帮我|能不能帮我)\s*",
    r"(?i)^(?:what is|what are|how does|how do|can you explain|can you summarize|please explain|please summarize|tell me about)\s+",
    r"(?i)(?:可以吗|好吗|呢|呀|啊|\?+|？+)\s*$",
)
KEYWORD_TOKEN = r"[A-Za-z][A-Za-z0-9._+-]*|\d{4}|[一-鿿]{2,}"

# ---- constraints in a question
YEAR_MIN, YEAR_MAX = 1950, 2100
NUMERALS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
FIELD_LABELS = {
    "source": ("source", "paper", "文献"), "title": ("title", "标题"), "author": ("author", "作者"),
    "venue": ("venue", "会议", "期刊"), "keyword": ("keyword", "关键词"),
}

# ---- references
REFERENCE_HEADINGS = ("references", "bibliography", "reference", "参考文献", "参考资料")
#: Words that a reference entry names its venue by.
VENUES = (
    "arxiv", "ieee", "acm", "springer", "nature", "science", "cvpr", "iccv", "eccv", "neurips", "icml", "acl", "emnlp", "naacl",
    "aaai", "ijcai", "kdd", "miccai", "tpami", "jmlr", "journal", "conference", "proceedings", "transactions",
)

# ---- first pages: fixed values of banner lines (patterns, lower case) and of venues that a title page names
PAGE_BANNERS = (
    r"^article in press$",
    r"^pdf download\b",
    r"^download\b",
    r"^open access support provided by",
    r"^citation in bibtex",
    r"^handling editor:\s*",
    r"^a\s*r\s*t\s*i\s*c\s*l\s*e\s*i\s*n\s*f\s*o$",
    r"^a\s*b\s*s\s*t\s*r\s*a\s*c\s*t$",
    r"^published:\s*",
    r"^received:\s*",
    r"^accepted:\s*",
    r"^available online\b",
    r"^supplementary material\b",
    r"^total citations?\b",
    r"total downloads",
    r"total citations",
    r"^(?:https?://|www\.)",
)
PAGE_VENUES = ("arxiv", "ieee", "acm", "springer", "nature", "science", "talanta", "cvpr", "iccv", "eccv", "neurips", "icml", "acl", "emnlp", "naacl", "aaai", "ijcai", "kdd", "miccai", "tpami", "jmlr")

# ---- readiness: what is missing by table, and how it is said
NOT_READY = {
    "chunks": "missing_main_chunk_corpus", "parents": "missing_parent_corpus", "papers": "missing_paper_corpus", "sections": "missing_section_summary_corpus",
    "catalog": "missing_paper_catalog", "references": "missing_reference_corpus",
}
NOT_READY_TEXTS = {
    "missing_main_chunk_corpus": "缺少主 chunk 语料缓存", "missing_parent_corpus": "缺少 parent 语料缓存", "missing_paper_corpus": "缺少 paper-level 语料缓存",
    "missing_section_summary_corpus": "缺少章节摘要缓存", "missing_paper_catalog": "缺少论文 catalog", "missing_reference_corpus": "缺少参考文献语料缓存",
}
SCOPE_TEXTS = {"main": "论文问答", "references": "参考文献检索"}
NOT_READY_FRAME = "{scope}所需知识库未就绪：{details}。请先完成入库或修复后再问答。"

# ---- front matter and section names
#: What stands before a text, in the order in which it goes.
FRONT_MATTER = (
    r"(?i)^article in press\s*", r"(?i)^pdf download .*? total citations:\s*\d+ .*? total downloads:\s*\d+\s*", r"(?i)^open access support provided by:?\s*", r"(?i)^citation in bibtex format\s*",
)
#: What stands before it after title and authors are gone.
NOTICES = (
    r"(?i)^(?:we are providing an unedited version of this manuscript .*? legal disclaimers apply\.?)\s*",
    r"(?i)^(?:if this paper is publishing under a transparent peer review model .*? final article\.?)\s*", r"(?i)^(?:copyright .*?)\s*",
)
NOISE_SECTIONS = (
    r"(?i)^(?:article|article in press|research-article)$", r"(?i)^(?:a\s*r\s*t\s*i\s*c\s*l\s*e\s*i\s*n\s*f\s*o)$",
    r"(?i)^(?:g\s*r\s*a\s*p\s*h\s*i\s*c\s*a\s*l\s*a\s*b\s*s\s*t\s*r\s*a\s*c\s*t)$", r"(?i)^(?:h\s*i\s*g\s*h\s*l\s*i\s*g\s*h\s*t\s*s)$",
    r"(?i)^(?:abstract|a\s*b\s*s\s*t\s*r\s*a\s*c\s*t)$", r"(?i)^(?:keywords|ccs concepts|acknowledg?ement|appendix a\. supplementary data)$",
)
NOISE_WORDS = ("et al", "university", "department", "institute", "hospital")
BANNER_WORDS = ("article in press", "pdf download", "total citations", "total downloads", "open access support provided by")

# ---- reranking: how a decision is recorded, by the gate's reason
DECISIONS = {
    "disabled": "conditional_disabled", "single": "single_candidate", "no_score": "missing_scores", "consensus": "high_confidence_skip", "rank_gap": "high_confidence_skip",
    "confident": "high_confidence_skip", "uncertain": "low_confidence_need_rerank",
}
# ---- what a prompt says of its context
SCOPE_HINTS = {
    "references": "以下上下文全部来自论文的参考文献列表。回答时只依据这些参考文献条目，优先回答是否引用、引用了哪些工作、涉及哪些作者或年份。",
    "survey": "以下上下文是论文级摘要与代表性证据的混合结果，请总结当前知识库覆盖范围内的研究脉络。",
    "metadata": "以下上下文优先包含论文级元数据与摘要，请优先回答题目、作者、年份、venue、关键词等结构化信息。",
}

# Fixed values of comparisons: words that say a question compares, where the things compared end, nouns that aren't part of a name.
COMPARES = ("比较", "对比", "区别", "差异", "异同", "共通", "共同点", "相同", "不同", "compare", "comparison", "difference", "different", "common", "similar", "vs")
CUTS = ("有什么", "是什么", "区别", "差异", "异同", "比较", "对比", "共通", "共同点", "difference", "differences", "common", "similar", "compare")
NOUNS = r"(?i)(的论文|模型|方法|架构|创新点|创新|共同点|共通点|区别|差异|异同|比较|对比|common points?|differences?|compare|comparison)$"

# Fixed values of abstracts: marks in a section's name, the word in a text, and what a text that ends an abstract looks like (lower case).
ABSTRACT_MARKS = ("abstract", "摘要")
ABSTRACT_WORD = r"(?:abstract|a\s*b\s*s\s*t\s*r\s*a\s*c\s*t)"
ABSTRACT_AFTER = r"\s*[:.]?\s*"
ABSTRACT_LEAST = 120
ABSTRACT_STOPS = (
    r"^\d+(?:\.\d+)*[.)]?\s+\S+",
    r"^(?:introduction|background|related work|methods?|materials|results?|discussion|conclusion)\b",
    r"^(?:contents lists available|keywords:|ccs concepts|acknowledg)",
    r"https?://|doi\.org",
)
