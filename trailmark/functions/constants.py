"""They decide results, so they must equal the published definitions."""

# Accuracy thresholds in kilometres.
KM_THRESHOLDS = [1, 25, 200, 750, 2500]
COMPARE_THRESHOLDS = [25, 200, 750, 2500]

# Distance score: (kilometres, score), linear in between, 0 beyond the last knot.
SCORE_KNOTS = [(1.0, 1.00), (25.0, 0.80), (200.0, 0.60), (750.0, 0.40), (2500.0, 0.20)]

EARTH_RADIUS_KM = 6371.0

# Difficulty bounds in kilometres.
EASY_KM = 25.0
MEDIUM_KM = 200.0

# GCJ-02 ellipsoid and bounding box.
GCJ_AXIS = 6378245.0
GCJ_ECCENTRICITY = 0.00669342162296594
CHINA_LON = (72.004, 137.8347)
CHINA_LAT = (0.8293, 55.8271)

# Tool names.
IMAGE_SEARCH = "image_search_tool"
TEXT_SEARCH = "text_search_tool"
ZOOM = "image_zoom_in_tool"

# Text that marks a tool response.
IMAGE_RESPONSE_MARK = "Image search results"
TEXT_RESPONSE_MARK = "Web search results"
QUERY_HEADER = "Web search results for:"

# Markers of a failed external call, per builder.
FAILURE_MARKERS = {
    "sft": [
        "Tavily search failed",
        "Image search failed",
        "all API keys exhausted",
        "COS upload error",
        "qcloud_cos",
    ],
    "rl": [
        "Image search failed",
        "Tavily search failed",
        "all API keys exhausted",
        "COS upload",
    ],
    "fallback": ["search failed", "api keys exhausted"],
    "notool": ["search failed", "api keys exhausted"],
}
# The fallback builder also looks for this one with its case kept.
FALLBACK_EXACT_MARKER = "API key not set"

SENTINELS = ["", "none", "null", "nan"]

NUDGE_PREFIX = "Your previous response ended without a tool call or final answer"

# Phrases that say no search result helped.
NO_RESULT_PHRASES = [
    "no results", "not helpful", "not useful", "no useful", "no relevant",
    "no information", "not related", "unrelated", "no match", "no matching",
    "none of", "none are", "nothing useful", "not geo", "no geo",
    "no location", "no specific location", "cannot determine",
    "没有有用", "没有相关", "没有帮助", "无法", "不相关",
]

# Phrases that signal a confident identification.
CONFIDENCE_PATTERN = (
    "(this is clearly|this is definitely|this is the famous|this is the iconic|"
    "this is the|unmistakabl|clearly identif|strongly (?:suggests|resembles|indicates)|"
    "signature (?:feature|architecture|colou?r)|distinctive (?:feature|landmark|architecture)|"
    "the famous|iconic (?:building|landmark|structure)|"
    "I recognize|I can identify|I know (?:this|that)|familiar (?:building|place|scene))"
)

# Phrases that announce a tool call inside reasoning.
TOOL_INTENT_PATTERN = (
    r"(?:\n+|\.\s+|^)("
    r"Let me\s+(?:search|verify|check|use|try|do|confirm)|"
    r"I(?:'ll| will)\s+(?:search|verify|check|use|try|do|confirm)|"
    r"I\s+should\s+(?:search|verify|check|use|try|call|do|confirm|utilize)|"
    r"I\s+need\s+to\s+(?:search|verify|check|use|try|confirm)|"
    r"I\s+could\s+use\s+(?:the\s+)?(?:image_search|text_search|image_zoom)|"
    r"I\s+can\s+use\s+(?:the\s+)?(?:image_search|text_search|image_zoom)|"
    r"I\s+(?:might|could|will)\s+(?:use|try|search|verify)\s+(?:the\s+)?(?:tool|image_search|text_search)|"
    r"Since\s+this\s+is\s+a\s+distinctive\s+landmark,?\s+I\s+should|"
    r"To\s+(?:verify|confirm|check|be certain|be sure)|"
    r"For\s+verification|"
    r"Let'?s\s+(?:search|verify|check|try|use)|"
    r"Now\s+I(?:'ll| will)\s+(?:search|verify|check|use|call)|"
    r"However,?\s+(?:to verify|to confirm|for verification|I should)|"
    r"But\s+(?:to verify|to confirm|let me|I should)"
    r")"
)
CONFIDENT_TAIL_WORDS = [
    "the location is", "coordinates are", "i can identify", "no tool",
    "without needing", "directly", "confident", "i recognize",
]
TOOL_MENTION_PATTERN = (
    "(image_search|text_search|image_zoom|tool_call|bbox_2d|let me search|let me verify|call.*tool|use.*tool)"
)

# The fallback builder's own cue list.
FALLBACK_CUE_PATTERN = (
    r"(?:\n+|\.\s+|^)("
    r"Let me (?:try|search|verify|check|use|do)|"
    r"I(?:'ll| will) (?:try|search|verify|check|use|do)|"
    r"I should (?:try|search|verify|check|use|call)|"
    r"I need to (?:try|search|verify|check|use)|"
    r"Let'?s (?:try|search|verify|check|use)|"
    r"Now I(?:'ll| will)"
    r")"
)
FALLBACK_TAIL_PATTERN = (
    r"\n+\s*(Let me (?:try|search|verify|check|use|do)|"
    r"I(?:'ll| will) (?:try|search|verify|check|use|do)|"
    r"I should (?:try|search|verify|check|use|call)|"
    r"Let'?s (?:try|search|verify|check|use)).*$"
)

# Call budgets per episode.
CALL_LIMITS = {ZOOM: 5, IMAGE_SEARCH: 3, TEXT_SEARCH: 5}

# Rewards.
REWARD_WEIGHTS = {"acc": 0.6, "fmt": 0.1, "tool": 0.3}
TOOL_SUM_BOUNDS = (-0.5, 1.0)
MCC_COEFF = 0.3
IOU_COEFF = 0.2
INVALID_BBOX_REWARD = -0.05
FORMAT_WEIGHT = 0.1

# Zoom geometry.
BBOX_SCALE = 1000.0
PIXEL_FACTOR = 28
MIN_SIDE = 28
MIN_PIXELS = 65536
MAX_PIXELS = 2097152
MAX_ASPECT = 100

# Sequence workload: LINEAR * length + length squared.
WORKLOAD_LINEAR = 24576

# Bound on a log ratio before it is exponentiated.
LOG_RATIO_BOUND = 20.0

# Answer normalisation for competition maths: (from, to), applied in this order.
MATH_SUBSTITUTIONS = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
MATH_REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots",
    "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}",
    "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]

# Data sources per scorer.
SCORER_SOURCES = {
    "gsm8k": ["openai/gsm8k"],
    "math_boxed": ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"],
    "math_line": ["math_dapo", "math", "math_dapo_reasoning"],
    "qa_em": [
        "searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa",
        "searchR1_2wikimultihopqa", "searchR1_musique", "searchR1_bamboogle",
    ],
}
MATH_LINE_PREFIX = "aime"

# Step-metric routing.
EXPLICIT_RULES = {
    "sum": ["perf/time_per_step"],
    "min": ["timing_s/agent_loop/tool_calls/min"],
    "avg": ["timing_s/agent_loop/tool_calls/mean"],
    "max": ["timing_s/agent_loop/tool_calls/max"],
    "last": [
        "fully_async/count/total_generated_samples",
        "fully_async/count/stale_samples_processed",
        "fully_async/count/stale_trajectory_processed",
        "fully_async/count/current_param_version",
        "fully_async/count/dropped_stale_samples",
        "training/global_step",
    ],
}

# LaTeX texts that are replaced before answers are compared, in this order.
LATEX_SPACING = [
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
    ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
]
LATEX_NUMBERS = [("\\\\%", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0.")]
