"""Word lists and patterns of the text rules."""

# They must equal the rules that results are held against.
STOPWORDS = """a an the and or of to in on for with is are was were be been being by at as it its
this that these those from which who whom what when where how why do does did has have had
not no can could should would will may might than then so such into over under about
between many much also""".split()

# Abbreviations that end no sentence.
ABBREVIATIONS = """e.g. i.e. etc. vs. fig. figs. eq. eqs. al. dr. mr. mrs. ms. prof. no. sec. ref. approx. inc. ltd.
st. cf. resp. vol. pp. p.""".split()

# Words that name no entity.
ENTITY_STOPWORDS = """
a about above after again against all am an and any are aren't as at be
because been before being below between both but by can't cannot could
couldn't did didn't do does doesn't doing don't down during each few for
from further get got had hadn't has hasn't have haven't having he he'd
he'll he's her here here's hers herself him himself his how how's i i'd
i'll i'm i've if in into is isn't it it's its itself let's me more most
mustn't my myself no nor not of off on once only or other ought our ours
ourselves out over own same shan't she she'd she'll she's should shouldn't
so some such than that that's the their theirs them themselves then there
there's these they they'd they'll they're they've this those through to too
under until up very was wasn't we we'd we'll we're we've were weren't what
what's when when's where where's which while who who's whom why why's will
with won't would wouldn't you you'd you'll you're you've your yours yourself
yourselves also can make may might need one two three four five six seven
eight nine ten said says used using thus hence therefore however although
within without per via such also well even just like type example e g i e
etc chapter section figure table page note see vs et al the a an
system data value object function return type class method property result
output input parameter variable list array set map key string number boolean
integer float null undefined true false new this error exception message
request response body header status code path version field name item
""".split()

# Keywords of the keyword graph.
GRAPH_KEYWORDS = """API REST FastAPI React Next.js Python Rust C++ PostgreSQL Database Vector Embedding RAG LLM Docker
Kubernetes Cache Redis JSON HTTP HTTPS Server Client Graph Node Edge Algorithm Pipeline Security Auth JWT""".split()

# What a line of a watermark says.
WATERMARKS = ["watermark", "confidential", "sample copy", "draft copy", "do not copy"]

# Patterns of entities, in order, and of their kinds.
ENTITY_PATTERNS = [
    r"\b([A-Z][a-zA-Z]{1,30}(?:[ \-][A-Z][a-zA-Z]{1,30}){0,3})\b",
    r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+[a-zA-Z0-9]*)\b",
    r"\b([A-Z]{2,10})\b",
    r"\b([a-zA-Z]{2,}(?:-[a-zA-Z]{2,})+)\b",
    r"\b([A-Za-z][A-Za-z0-9]*[\s\-/](?:v?\d+(?:\.\d+)*))\b",
]
TECH_ENDING = (
    r"(?:API|SDK|DB|SQL|NoSQL|ORM|CLI|GUI|UI|UX|JWT|HTTP|REST|RPC|gRPC|"
    r"CSS|HTML|JSON|YAML|XML|RAG|LLM|ML|AI|GPU|CPU|CDN|DNS|TCP|UDP|TLS|SSL|"
    r"OAuth|CRUD|ACID|BASE|CAP|HNSW|BM25|RRF|NLP|NER|TF|IDF|Transformer|"
    r"Embedding|Encoder|Decoder|Attention|Retriever|Reranker|Vector|Tokenizer|"
    r"Bert|GPT|LLaMA|Mistral|T5|CLIP|LoRA|PEFT|RAG|Chain|Prompt|Context)s?$"
)
ORG_ENDING = (
    r"(?:Inc\.?|Ltd\.?|Corp\.?|LLC\.?|LLP|Co\.?|Company|Foundation|"
    r"Institute|University|College|Lab(?:s)?|Research|Group|Center|Centre)$"
)
PERSON_START = r"^(?:Dr|Mr|Mrs|Ms|Prof|Sir|Dame)\.?\s"

# Patterns of sensitive data.
SENSITIVE = {
    "emails": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "ids": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b",
    "cards": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b",
    "phones": r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
}

# Fixed value: where a sentence may end.
BOUNDARY = r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])|\n{2,}"
