"""Word lists, patterns and tables that results depend on."""

# Stopwords of the answering overlap.
ANSWER_STOPWORDS = """a an and are as at be been but by for from had has have if in into is it its
must no not of on or shall should such that the their there these this to was
were which who will with within would""".split()

# Stopwords of the failure analysis.
FAILURE_STOPWORDS = """a an and are as at be been but by for from had has have if in into is it its
must no not of on or shall should such that the their there these this to was
were which who will with within would what when how does do can may any""".split()

# Words that feedback never adds to a query.
FEEDBACK_STOPWORDS = """about above after again against all also among and any are because been
before being below between both but came come could does doing down during
each either else even ever every from further had has have having here hers
herself him himself his how however into its itself just like made make many
more most much must nor not now only other ought our ours ourselves out over
own same shall should since some such than that the their theirs them
themselves then there these they this those through thus too under until upon
very was were what when where whether which while who whom whose why will
with within without would your yours yourself subject related effective
legal general specific include including includes""".split()
FEEDBACK_NOISE = """insurance insurer company companies central bank authority regulation
regulations article articles section sections may board provisions
accordance provided respect relevant applicable requirements pursuant""".split()

# Status spellings.
STATUSES = {
    "in-force": "in_force",
    "in force": "in_force",
    "superseded": "superseded",
    "repealed": "repealed",
    "revoked": "repealed",
    "not yet in force": "not_yet_in_force",
}

# Query and passage prefixes by model name; the first that fits counts.
INSTRUCTIONS = [
    ("BAAI/bge", "Represent this sentence for searching relevant passages: ", ""),
    ("intfloat/e5", "query: ", "passage: "),
    ("intfloat/multilingual-e5", "query: ", "passage: "),
    ("thenlper/gte", "", ""),
    ("sentence-transformers/", "", ""),
]

# Obligation patterns, strongest force first. Prohibitions are cut out before the others are looked for.
FORCES = {
    "prohibitive": r"(?iU)\b(?:shall\s+not|must\s+not|may\s+not|cannot|can\s+not|is\s+not\s+permitted|are\s+not\s+permitted|shall\s+refrain|prohibited|forbidden|no\s+\w+\s+shall)\b",
    "mandatory": r"(?iU)\b(?:shall|must|is\s+required\s+to|are\s+required\s+to|is\s+obliged\s+to|required\s+to|obligated\s+to|has\s+to|have\s+to)\b",
    "permissive": r"(?iU)\b(?:may|is\s+permitted|are\s+permitted|is\s+allowed|are\s+allowed|is\s+entitled|are\s+entitled|can\b|at\s+its\s+discretion)\b",
    "advisory": r"(?iU)\b(?:should|ought\s+to|is\s+encouraged|are\s+encouraged|is\s+expected\s+to|are\s+expected\s+to|best\s+practice|recommended)\b",
}
#: Of these, one stands in every text that the pattern of a force is found in.
FORCE_STEMS = {
    "prohibitive": ["shall", "must", "may", "can", "permitted", "prohibited", "forbidden"],
    "mandatory": ["shall", "must", "required", "obliged", "obligated", "has", "have"],
    "permissive": ["may", "permitted", "allowed", "entitled", "can", "discretion"],
    "advisory": ["should", "ought", "encouraged", "expected", "best", "recommended"],
}
FORCE_ORDER = ["prohibitive", "mandatory", "permissive", "advisory", "none"]

# Patterns of references between sections.
MENTION = r"(?<!sub-)(?<!sub )\b(?:Article|Clause)s?\s*\(?(\d{1,3})(?:[.\-/][\w.]+)?\)?"
CONTINUATION = r"\s*(,|and|to|through|&)\s*\((\d{1,3})\)"
INSTRUMENT_WORD = "(?:Regulation|Regulations|Standard|Standards|Instruction|Instructions|Decision|Resolution|Law|Section|Chapter|Article)"
SAME_INSTRUMENT = rf"^\s*(?:above|below|herein|hereof)?\s*(?:of|in|to)?\s*(?:(?:this|these|the\s+present)\s+{INSTRUMENT_WORD}|the\s+{INSTRUMENT_WORD}\s+herein)"
SELF_AFTER = r"^\s*(?:of\s+)?this\s+Article"
SELF_BEFORE = r"\bthis\s+$"
COMPANION = r"^\s*of\s+the\s+(Standards?|Regulations?)\b"
QUALIFIER = r"^\s*of\s+(?:Chapter|Section|Part)\s+\(?([IVXLC]+|\d{1,2})\)?"
EXTERNAL = r"^\s*of\s+(?:the\s+)?(?:Central\s+Bank\s+Law|Federal\s+Law|Federal\s+Decree|Decretal\s+Federal|Cabinet\s+Resolution|Law\s+No|Executive\s+Regulations?|Implementing\s+Regulations?|Commercial\s+Companies)"
OTHER_INSTRUMENT = r"^\s*of\s+(?:the|these)\s+[A-Z]"
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
MAX_RANGE = 20

# Forms of section headings, by the label that they give; the first that fits counts.
ARTICLE = r"^Article\s*\(?\s*(\d+)\s*\)?"
LETTERED = r"^(Appendix|Annex|Schedule)\s*(?:No\.?)?\s*\(?\s*([0-9]+|[A-Z])\s*\)?"
DIVISION = r"^(Chapter|Part|Section)\s*\(?\s*([A-Za-z]+|\d+)\s*\)?"
DOTTED = r"^(\d+(?:\.\d+)+)"
FLAT = r"^(\d+)\s*[.)]\s+\S"
CONTAINER = r"^(Chapter|Part|Section)\b"

# What a generated context may begin with, and its first sentence.
PREAMBLE = r"^(sure|certainly|here is|here's)[^:]*:\s*"
FIRST_SENTENCE = r"^(.{20,400}?[.!?])(\s|$)"

# Names of instruments in running text, and who means the counterpart by them.
ALIASES = {
    "financial regulations": "INS-FIN-001",
    "risk management and internal controls regulation": "INS-GOV-003",
    "risk management and internal controls standards": "INS-GOV-004",
    "corporate governance regulation": "INS-GOV-001",
    "corporate governance standards": "INS-GOV-002",
    "insurance group supervision regulation": "INS-OTH-003",
    "climate-related financial risk management regulation": "INS-GOV-007",
    "regulation regarding takaful insurance": "INS-TAK-001",
    "takaful insurance regulation": "INS-TAK-001",
}
COUNTERPARTS = {"INS-FIN-001": "INS-FIN-002"}

# Enumerations of the question schema.
CATEGORIES = ["single_hop", "cross_section", "cross_document", "comparative", "adversarial", "unanswerable"]
DIFFICULTIES = ["easy", "medium", "hard"]
CONFIDENCES = ["high", "medium", "low"]
REFUSAL = "not covered by these passages"

# Where a page names its node, its date, its status and its code.
NODE = r"page-node-(\d+)"
EFFECTIVE = r"Effective from\s*([\d/]+)"
STATUS_LINE = r"Status:\s*([A-Za-z \-]+)"
INSTRUMENT_CODE = r"\n\s*([A-Z]{1,3}\s?\d+/\d{4})\s*(?:Effective|\n)"
