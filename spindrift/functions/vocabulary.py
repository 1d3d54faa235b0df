"""Fixed values of the retrieval system: word lists, maps and constants, in one place."""

# --- fixed values -----------------------------------------------------------------------------

NOISE_WORDS = """
a an the and or but if then else of in on at to for from with without by as is
are was were be been being do does did have has had can could should would will
my me i you your it its this that these those there here what how why when
""".split()

ACRONYMS = {
    "GTM": "go-to-market",
    "B2B": "business-to-business",
    "B2C": "business-to-consumer",
    "D2C": "direct-to-consumer",
    "DTC": "direct-to-consumer",
    "SaaS": "software as a service",
    "PaaS": "platform as a service",
    "IaaS": "infrastructure as a service",
    "PLG": "product-led growth",
    "SLG": "sales-led growth",
    "CLG": "community-led growth",
    "ICP": "ideal customer profile",
    "TAM": "total addressable market",
    "SAM": "serviceable addressable market",
    "SOM": "serviceable obtainable market",
    "ARR": "annual recurring revenue",
    "MRR": "monthly recurring revenue",
    "NRR": "net revenue retention",
    "GRR": "gross revenue retention",
    "CAC": "customer acquisition cost",
    "LTV": "lifetime value",
    "CLTV": "customer lifetime value",
    "ACV": "annual contract value",
    "TCV": "total contract value",
    "AOV": "average order value",
    "ARPU": "average revenue per user",
    "ARPA": "average revenue per account",
    "CPA": "cost per acquisition",
    "CPL": "cost per lead",
    "CPC": "cost per click",
    "CPM": "cost per mille",
    "CTR": "click-through rate",
    "CVR": "conversion rate",
    "MQL": "marketing qualified lead",
    "SQL": "sales qualified lead",
    "PQL": "product qualified lead",
    "OKR": "objectives and key results",
    "KPI": "key performance indicator",
    "NPS": "net promoter score",
    "CSAT": "customer satisfaction",
    "CES": "customer effort score",
    "PMF": "product-market fit",
    "MVP": "minimum viable product",
    "POC": "proof of concept",
    "PRD": "product requirements document",
    "BRD": "business requirements document",
    "SOW": "statement of work",
    "SLA": "service level agreement",
    "ROI": "return on investment",
    "ROAS": "return on ad spend",
    "P&L": "profit and loss",
    "EBITDA": "earnings before interest taxes depreciation and amortization",
    "COGS": "cost of goods sold",
    "OPEX": "operating expenditure",
    "CAPEX": "capital expenditure",
    "QBR": "quarterly business review",
    "ABM": "account-based marketing",
    "SEO": "search engine optimization",
    "SEM": "search engine marketing",
    "CRM": "customer relationship management",
    "ERP": "enterprise resource planning",
    "ETL": "extract transform load",
    "API": "application programming interface",
    "SDK": "software development kit",
    "CI/CD": "continuous integration and continuous delivery",
    "ML": "machine learning",
    "LLM": "large language model",
    "RAG": "retrieval augmented generation",
    "GenAI": "generative artificial intelligence",
    "AI/ML": "artificial intelligence and machine learning",
    "NLP": "natural language processing",
    "RPA": "robotic process automation",
    "IOT": "internet of things",
    "IoT": "internet of things",
    "HIPAA": "health insurance portability and accountability act",
    "SOC": "system and organization controls",
    "GDPR": "general data protection regulation",
    "SSO": "single sign-on",
    "RBAC": "role-based access control",
    "MFA": "multi-factor authentication",
    "VPC": "virtual private cloud",
    "CDN": "content delivery network",
    "DNS": "domain name system",
}

DOMAINS = ["AI", "business", "career", "finance", "learning", "personal", "product", "strategy", "technical", "writing"]

INTENT_KEYWORDS = {
    "build": ["build", "create", "implement", "develop", "make", "construct", "design", "setup", "architect"],
    "debug": ["debug", "fix", "troubleshoot", "error", "bug", "crash", "issue", "problem", "wrong", "fails", "broken"],
    "analyze": ["analyze", "review", "examine", "evaluate", "assess", "audit", "check", "understand", "investigate", "explore"],
    "improve": ["improve", "optimize", "enhance", "refactor", "upgrade", "better", "faster", "more efficient"],
    "document": ["document", "write", "explain", "describe", "spec", "specification", "guide", "tutorial"],
    "plan": ["plan", "strategy", "roadmap", "approach", "decide", "choose", "prioritize"],
    "test": ["test", "verify", "validate", "qa", "quality", "check"],
    "deploy": ["deploy", "release", "ship", "launch", "publish", "push"],
    "security": ["security", "vulnerability", "secure", "auth", "permission", "access", "protect"],
    "data": ["data", "database", "query", "sql", "transform", "pipeline", "etl"],
}

DOMAIN_KEYWORDS = {
    "technical": ["code", "programming", "software", "api", "server", "database", "docker", "kubernetes", "devops", "infrastructure", "backend", "frontend", "web", "app", "algorithm", "system", "architecture", "python", "javascript", "java", "go", "rust", "sql", "linux", "git", "testing", "debugging", "refactor"],
    "AI": ["ai", "machine learning", "ml", "model", "llm", "gpt", "embedding", "training", "inference", "prompt", "rag", "vector", "nlp", "neural", "deep learning", "transformer", "classification", "clustering"],
    "business": ["business", "revenue", "growth", "market", "customer", "sales", "marketing", "strategy", "company", "enterprise", "roi", "kpi", "metric", "budget", "cost", "pricing"],
    "strategy": ["strategy", "strategic", "roadmap", "vision", "goal", "objective", "planning", "competitive", "advantage", "positioning"],
    "product": ["product", "feature", "user experience", "ux", "ui", "design", "requirement", "specification", "roadmap", "launch"],
    "finance": ["finance", "financial", "investment", "budget", "cost", "revenue", "profit", "pricing", "valuation", "financial model", "forecast", "cash flow"],
    "career": ["career", "job", "resume", "interview", "promotion", "salary", "skills", "professional", "development", "leadership"],
    "learning": ["learn", "study", "education", "course", "training", "knowledge", "skill", "practice", "teach"],
    "personal": ["personal", "life", "habit", "goal", "productivity", "health", "wellness", "organization"],
    "writing": ["write", "writing", "content", "copy", "blog", "article", "documentation", "story", "narrative"],
}

WORKFLOW_VERBS = """
build create design develop implement write debug fix troubleshoot diagnose resolve
review audit evaluate assess analyze compare plan strategize outline architect map
optimize improve refactor restructure migrate test validate verify benchmark
deploy launch ship release document explain summarize research investigate explore
generate draft compose produce
""".split()

FOLLOWUPS = [
    "yes", "no", "yeah", "yep", "nope", "nah", "ok", "okay", "sure", "thanks", "thank you", "thx",
    "got it", "makes sense", "sounds good", "looks good", "perfect", "great", "nice", "cool", "awesome",
    "do it", "go ahead", "proceed", "continue", "agreed", "correct", "right", "exactly",
    "nevermind", "never mind", "nvm", "cancel",
]

GREETING = r"(?i)^(hi|hello|hey|good morning|good afternoon|good evening|what's up|howdy|sup)\b"

OVERLAP_STOPWORDS = """
the and for with that this you your are was how what why when should would could can get
use using from into about have has not but
""".split()

SLOT_BLACKLIST = "YOUR OR AND IF THEN ELSE NOT YES NO E.G. IE EG OPTIONAL REQUIRED NOTE IMPORTANT EXAMPLE SEE REFER ALSO".split()
PASTE_WORDS = ["paste", "insert", "attach", "copy", "provide"]

SPEC_TOKEN = (
    r"\w+/[\w./-]+|\w+\.(?:py|js|ts|json|toml|md|txt|sh|yaml|yml|rs|go)\b|\w+\([^)]*\)|\w+_\w+"
    r"|[A-Z]{2,}[A-Z_]*=|--?[a-zA-Z][\w-]+|==|!=|->|=>|>=|<=|`[^`]+`|\"[^\"]{1,40}\"|'[^']{1,40}'"
)

IMAGE_QUERY = (
    r"(?i)\b(?:generate|render|produce|edit|animate)\s+(?:(?:an?|the)\s+)?(?:[a-z-]+\s+){0,3}"
    r"(?:image|images|video|videos|visual|visuals|animation|animations)\b"
    r"|\b(?:image|images|video|videos|visual|visuals|animation|animations)\s+(?:generation|generating|rendering|editing|animation)\b"
)
IMAGE_TITLE = "image gen"

INVERSE_METRICS = ["COGS", "Sales & Marketing", "R&D", "G&A", "Headcount", "CAC"]

STATUSES = ["draft", "active", "inactive"]
OUTCOMES = {"success": 1.0, "partial": 0.5, "failure": 0.0}
ACTIONS_DONE = ["completed", "aborted", "expired"]

CANDIDATES, TOP_K, RRF_K, WEIGHTS = 50, 10, 50, (0.5, 0.5)
MAX_DF, MAX_TERMS = 0.15, 4
PER_CHANNEL = 20
MAX_DOC_CHARS, MAX_QUERY_CHARS = 4000, 500
LENGTH_FROM, LENGTH_STRENGTH, LENGTH_CURVE = 2200, 0.02, 0.5
BOOSTS = {"domain": 0.06, "recurring": 0.03, "intent": 0.04, "insight": 0.02, "prior": -0.10}
PRIOR_UNUSED_BELOW = 0.4
MIN_CONFIDENCE = 0.8
MIN_MATCHED_STEPS, TOP_WINDOW = 2, 10
CHUNK_TARGET, CHUNK_CEILING, CHUNK_FLOOR = 1600, 4000, 320
GATE_SIMILARITY, GATE_WORDS, GATE_DENSITY = 0.58, (5, 60), 0.08
DRIFT_HIGH, DRIFT_RELAX, DOMAIN_RELAX = 0.6, 0.03, 0.05
MIN_IMPROVEMENT = 0.05
CLASSIFIER_CONFIDENCE = 0.80
SERVED_CANDIDATES = 10
PRIOR_WEIGHT, PRIOR_MEAN = 5, 0.5
SKILL_BOOST = 0.05
TSVECTOR_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
