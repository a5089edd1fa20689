"""Word lists, patterns, weights and formats that define the results."""

# --- scoring ---------------------------------------------------------------------------
KNOWN_DOMAINS = [
    "RAG", "Fine-tuning", "Reasoning", "Vision", "Multimodal",
    "LLM", "Diffusion", "NLP", "RL", "Agents", "Robotics",
    "Optimization", "Efficiency", "Training", "Alignment",
]
THEORY_WORDS = [
    "bound", "bounds", "convergence", "proof", "theorem",
    "regularity", "theoretical", "asymptotic", "lemma",
]
PRACTICAL_WORDS = [
    "github", "code", "implementation", "released",
    "experiment", "benchmark", "dataset",
]
INFRA_WORDS = [
    "latency", "memory", "throughput", "faster", "speed",
    "flops", "utilization", "efficient", "compress", "quantiz",
]
GENERIC_REASON_PHRASES = ["llms, agents, multimodal, diffusion", "large language model"]
ACTION_STEPS = [(4.0, "Skip"), (6.0, "Experiment"), (8.0, "Strong Experiment")]
ACTION_TOP = "Adopt"

CLASSIFIER_KEYS = ["domain", "novelty", "contributions", "has_code"]
SCORER_KEYS = ["overall_score", "reproducibility", "compute_cost", "latency", "adoption", "reasoning"]
SCORER_RANGES = {
    "overall_score": (0.0, 10.0), "reproducibility": (0.0, 10.0), "compute_cost": (0.0, 10.0),
    "latency": (0.0, 10.0), "adoption": (0.0, 10.0),
}
BRIEF_KEYS = ["summary", "stack_fit", "action", "action_reason"]

THINK_PATTERN = r"(?s)<think>.*?</think>"
FENCE_PATTERN = r"```(?:json)?\s*|\s*```"
HYPE_SCORE_PATTERN = r'"hype_score"\s*:\s*([0-9]+(?:\.[0-9]+)?)'
HYPE_REASON_PATTERN = r'"reason"\s*:\s*"([^"]{0,200})'

# --- ingest ----------------------------------------------------------------------------
DEFAULT_CATEGORIES = ["cs.AI", "cs.LG", "cs.CL", "cs.CV", "stat.ML"]
REPO_LINK_PATTERN = r"(?i)https?://github\.com/[A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+"
PAPER_ID_PATTERN = r"[0-9]{4}\.[0-9]{4,5}"
PAPER_URL_PREFIX = "https://arxiv.org/abs/"

# --- growth ----------------------------------------------------------------------------
VELOCITY_WINDOW_DAYS = 7.0
STAR_WEIGHT, CITATION_WEIGHT = 0.6, 0.4
STARS_PER_DAY_FULL, CITATIONS_PER_DAY_FULL = 100.0, 10.0

# --- chunking --------------------------------------------------------------------------
SECTION_PATTERN = (
    r"^([0-9]+\.?[0-9]*\.?\s+)?"
    r"(Abstract|Introduction|Related Work|Background|Preliminaries|"
    r"Notation|Methodology|Method|Approach|Model|Architecture|Framework|"
    r"Experiments?|Results?|Evaluation|Analysis|Ablation Study|"
    r"Discussion|Conclusion|Limitations?|Future Work|"
    r"References?|Appendix[A-Z\s]?|[A-Z][A-Za-z\s&:,\-]{3,60})$"
)
MATH_PATTERN = (
    r"(\$.*?\$|\\[a-zA-Z]+\{|\\frac|\\sum|\\int|"
    r"[∑∫≈→←⊕‖]|[0-9]+\.[0-9]+e[-+][0-9]+|Equation\s+[0-9]+)"
)
LIST_PATTERN = r"(?m)^\s*[1-9][.)]\s+|^\s*[-•]\s+"
CAPTION_PATTERN = r"(?i)^(Fig\.?|Figure|Table)\s*[0-9]+"
NOISE_PATTERN = r"^[0-9\s\.]+$|^[A-Z\s]{2,6}$|^\s*[0-9]+\s*$|^https?://\S+$"

# --- retrieval -------------------------------------------------------------------------
KEYWORD_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was",
]
EXPANSIONS = {
    "problem": "limitation challenge issue drawback weakness failure",
    "challenge": "limitation problem difficulty obstacle constraint",
    "limitation": "problem challenge weakness drawback shortcoming",
    "contribution": "novelty proposal method result achievement",
    "method": "approach algorithm technique methodology procedure",
    "result": "performance accuracy benchmark evaluation experiment finding",
    "how": "mechanism process steps procedure implementation",
    "compare": "versus difference advantage disadvantage tradeoff",
    "equation": "formula derivation loss objective function",
    "architecture": "model structure layer design component module",
    "figure": "diagram illustration visualization caption table",
}
SECTION_BOOSTS = {
    "implement": ["Method", "Algorithm", "Architecture", "Framework", "Pipeline", "System", "Approach", "Implementation"],
    "math": ["Preliminaries", "Notation", "Background", "Method", "Proof", "Theorem", "Derivation", "Analysis"],
    "results": ["Experiments", "Results", "Evaluation", "Ablation", "Benchmark", "Performance", "Comparison"],
    "formula": ["Method", "Preliminaries", "Notation", "Background", "Derivation", "Objective", "Loss"],
}
LIST_TRIGGERS = [
    "problem", "challenge", "limitation", "step", "contribution",
    "what are", "approach", "method", "how does", "key", "main",
]
CAPTION_QUERY_PATTERN = r"(?i)\b(figure|fig|diagram|table|illustration|plot|chart)\b"
CHAIN_INTENTS = ["implement", "math", "formula"]

# --- questions -------------------------------------------------------------------------
OFF_TOPIC_PATTERNS = [
    r"\bwrite (me )?(a |an )?(poem|story|essay|song|joke|email|letter)\b",
    r"\bgenerate (a |an )?(image|picture|photo|video)\b",
    r"\bwhat('s| is) the weather\b",
    r"\b(bitcoin|crypto|stock price|exchange rate)\b",
    r"\bignore (all |previous |your )?(instructions|rules|system prompt)\b",
    r"\bforget (all |your )?(instructions|context)\b",
    r"\byou are now\b",
    r"\bjailbreak\b",
    r"\bbypass (your |all )?(filters|restrictions)\b",
    r"\breveal (your |the )?(api key|secret|password|token)\b",
]
GLOBAL_INTENT_PATTERNS = {
    "latest": [
        r"\b(latest|recent|new|newest|this week|today|2024|2025|2026)\b",
        r"\bwhat('s| is) new\b",
        r"\bjust (released|published|came out)\b",
        r"\bcutting.?edge\b",
        r"\bstate.?of.?the.?art\b",
    ],
    "learning": [
        r"\b(learn|understand|study|intro|introduction|beginner|start|get started)\b",
        r"\bhow (do i|to) (learn|understand|get started)\b",
        r"\bbest papers (to|for) (learn|understand|read)\b",
        r"\bprimer\b", r"\btutorial\b", r"\bfoundation\b",
    ],
    "practical": [
        r"\b(production|deploy|implement|integrate|use in|build|ship)\b",
        r"\b(practical|real.?world|industry|applied)\b",
        r"\bstack (fit|compatible|works with)\b",
        r"\b(pytorch|huggingface|fastapi|triton|vllm)\b",
    ],
    "compare": [
        r"\bvs\.?\b", r"\bversus\b", r"\bdifference between\b",
        r"\bcompare\b", r"\bbetter than\b", r"\btradeoff\b",
        r"\badvantage|disadvantage\b",
    ],
    "recommend": [
        r"\b(recommend|suggest|best|top|should i read|worth reading)\b",
        r"\bwhat (papers?|are) (good|best|worth)\b",
        r"\bgive me (papers?|recommendations?)\b",
    ],
}
DEEP_INTENT_PATTERNS = {
    "formula": (3, [r"\b(formula|equation|notation|loss function|objective)\b",
                    r"\bwhat('s| is) the (formula|equation|math|loss)\b"]),
    "math": (3, [r"\b(proof|derivation|theorem|lemma|derive)\b", r"\bmath(ematical)?\b"]),
    "implement": (3, [r"\b(implement|code|build|write|create|reproduce|script)\b",
                      r"\bhow (do i|to|can i) (use|integrate|run|apply|set up)\b",
                      r"\bshow.{0,20}(code|implementation)\b"]),
    "results": (2, [r"\b(results?|findings?|performance|benchmark|accuracy|evaluation|scores?)\b"]),
    "compare": (2, [r"\bvs\.?\b", r"\bversus\b", r"\bdifference between\b", r"\bcompare\b"]),
    "explain": (1, [r"\bwhat is\b", r"\bhow does\b", r"\bexplain\b", r"\bwhy does\b", r"\bintuition\b",
                    r"\bsummar(ize|y)\b"]),
    "short": (3, [r"\bwho (wrote|authored|created)\b", r"\bwhen was\b", r"\bhow many\b"]),
}
CHUNK_BUDGETS = {
    "formula": 6, "short": 5, "results": 10, "compare": 12,
    "explain": 12, "discuss": 10, "math": 15, "implement": 20,
}
PRECISE_INTENTS = ["math", "implement", "formula"]
LENGTH_LIMITS = {
    "formula": "5 variables", "math": "400 words", "implement": "100 words", "results": "150 words",
    "compare": "250 words", "explain": "300 words", "short": "2 sentences", "discuss": "3 paragraphs",
}
DECOMPOSE_IMPLEMENT_ALWAYS = [
    " architecture components layers modules",
    " forward pass training objective loss function",
    " implementation details pseudocode algorithm steps",
    " appendix hyperparameters configuration training",
]
DECOMPOSE_IMPLEMENT_TRIGGERED = [
    (["diffusion", "unet", "denoising", "score"], " noise schedule time embedding sinusoidal"),
    (["attention", "transformer", "cross-attention"], " attention mechanism query key value projection"),
    (["encode", "decode", "latent", "vae", "variational"], " encoder decoder latent space reparameterization"),
    (["retriev", "rag", "index", "embed"], " retrieval index embedding similarity search"),
    (["graph", "node", "edge", "gnn"], " graph construction node features adjacency"),
    (["train", "fine-tun", "lora", "finetun"], " training loop optimizer learning rate schedule"),
]
DECOMPOSE_SYSTEM_WORDS = ["architecture", "framework", "system", "pipeline", "design"]
DECOMPOSE_SYSTEM = [" workflow components execution flow", " system design overview"]
DECOMPOSE_MATH = [" derivation proof notation formulation", " objective function loss optimization"]
DECOMPOSE_FORMULA = [" equation definition notation variables"]
ANSWER_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was",
    "were", "this", "that", "we", "our", "it", "its", "be", "as", "if", "so", "do", "not", "have", "has", "can", "will",
]
CAVEAT = (
    "\n\n*Note: parts of this answer extend beyond the retrieved sections — verify against the paper.*"
)

# Texts that stand in where nothing was found (fixed values).
NO_PAPERS_TEXT = "No relevant papers found in the database or ArXiv."
NOT_INDEXED_NOTE = "Note: Full PDF not indexed. Click 'Index PDF' for section-level precision."
