"""Words and word pairs of the boundary and fragment rules, in plain text."""

DETERMINERS = "the a an this that these those our their its"
NUMERALS = "one two three four five six seven eight nine ten hundred thousand million billion"
NOT_NOUNS = "and or but to of in on for with"

AUXILIARIES = (
    "am is are was were be been being do does did don't doesn't didn't have has had haven't hasn't hadn't can can't could "
    "couldn't will won't would wouldn't shall should shouldn't may might must"
)
PREDICATE_STARTS = "be been being have do go make take get work build hire view know automated upending"
SHORT_SUBJECTS = "i you we they he she it ai"
FINITE_VERBS = "am is are was were do does did have has had can could will would should need needed needs tend tends"
TRANSITIVE = "issued helped made make makes cause causes taking build building hire hired expose exposed"
OBJECT_STARTS = "a an the this that these those his her its their our"
COMPLEMENT_HEADS = "expose hire view know build building automated extinct available possible necessary"
CATENATIVE = "helped help helps make makes made seems feels"
COMPLEMENT_ADJECTIVES = "extinct heavy available possible necessary"
COMPOUND_HEADS = "job jobs displacement building market markets hours journalist warning tradeoff profession professions"
COMPOUND_MODIFIERS = "skill corporate job prize-winning pulitzer large-scale high-paying public career market"
MODIFIER_PAIRS = [
    "loaded motorized", "dense chaotic", "secretive regional", "healthy cash", "corporate solvency", "strategic pathway",
    "traditional high", "traditional fast", "long-term regional", "economic miracle", "subsequent slowdown", "deep physical",
    "creative drive",
]
NAMED_PAIRS = [
    "wall street", "south korea", "north korea", "new york", "silicon valley", "sk hynix", "goldman sachs", "federal reserve",
    "united states", "saudi arabia", "elon musk", "jensen huang", "world bank",
]
PARTICLE_PAIRS = [
    "look at", "looks at", "looked at", "looking at", "refer to", "refers to", "referred to", "referring to", "focus on",
    "focuses on", "focused on", "focusing on", "deal with", "deals with", "dealt with", "dealing with", "relate to", "relates to",
    "related to", "relating to",
]
PHRASAL_PAIRS = [*PARTICLE_PAIRS, "pricing in", "priced in", "price in", "hunkering down", "forced to", "trying to", "able to", "going to"]
DIRECTIONS = "into onto through across around over under up down out off away"
DIRECTION_ADVERBS = "straight directly right"
HALF_DAYS = "m am pm a.m p.m"
INFINITIVES = "be build construct create do earn explain get go hire keep make move read see take use work write"
TAKES_WITH = "met filled dealing faced facing popular concerned"
EMPHASIS_PAIRS = ["never ever", "not ever"]
QUANTIFIED = ["few thousand", "few hundred", "several thousand"]
ADVERB_ADJECTIVES = "valuable concerned important likely clear specific heavy good"
ADVERB_ENDINGS = "able ible al ed ent ant ful ic ive less ous ary ory"
CHAIN_MODIFIERS = (
    "massive major minor huge small large deep economic social financial political cultural structural public private global "
    "local traditional modern invisible aggressive"
)
COORDINATED_LEFT = "economic social financial political cultural structural"
TRANSITIONS = "alternatively however therefore instead meanwhile"

NOT_HEADS = "and or but of to in on for with"
ADJECTIVE_ENDINGS = "al ful ive ous ic ary ory less able ible ent ant ed ing"
HEAD_NOUNS = (
    "area asset assets budget category city cities economy ecosystem harbors holdings market markets pedestrian policy power "
    "province provinces revenue industry life resources shift space state systems tower value wealth expansion optimization "
    "sector job jobs day days shifts graduate graduates future present majority capital thing trajectory investor investors "
    "wait scooter traffic pitch solvency pathway miracle slowdown drive memory funds monopolies"
)
HEAD_ADJECTIVES = (
    "complete existing grueling high-tech intensive massive outward own private publicly recurring relentless sprawling state "
    "structural sustainable today's vast corporate exact same largest strict loaded motorized dense chaotic secretive regional "
    "healthy strategic traditional fast long-term economic subsequent deep physical creative"
)
NOUN_MODIFIERS = "asset assets budget cash land private public sector state usage waterfront"
FINAL_ADJECTIVES = "clear specific important good bad true false right wrong possible necessary available ready"

DANGEROUS_ENDS = (
    "a an the my your his her its our their to of for with by from at in between on around as that which who what where when "
    "because although if and or but is are was were be been being have has had could would should might must will can do does "
    "did just this"
)
DANGEROUS_STARTS = (
    "of for with by from at in on around as to that which who what where when though too either also anymore"
)
BAD_LEFT = (
    "of for with by to around a an the my your his her its our their could would should might will can must between this just "
    "because which that what"
)
BAD_PAIRS = [
    "used to", "have to", "has to", "had to", "having to", "going to", "need to", "needs to", "look at", "rely on", "defined by",
    "sense of", "right around", "all triggered", "private sector", "sector job", "hour day", "hour days", "12 hour", "twelve hour",
    "weekend shift", "weekend shifts", "side of",
]

PRONOUNS = "we they he she it i you"
REFLEXIVES = "itself himself herself themselves ourselves"
ONE_WORD_MARKERS = "yeah right exactly precisely okay ok wow"

TRAILING_CONNECTORS = "and but or so"
TRAILING_AUXILIARIES = (
    "am is are was were be been being do does did have has had can could will would shall should may might must it's that's "
    "there's he's she's what's"
)
TRAILING_QUANTIFIERS = "all both either neither"
FINITE_OR_AUXILIARY = (
    "am is are was were be been being do does did have has had can could will would shall should may might must isn't aren't "
    "wasn't weren't haven't hasn't hadn't don't doesn't didn't can't couldn't won't wouldn't tend tends need needs needed"
)
COMMON_VERBS = "changed worked reported started ended matters matter happened became felt seemed"
QUESTION_WORDS = "how what why where when who which"
QUESTION_AUXILIARIES = "am is are was were do does did can could will would should have has had"
OPENERS = "yeah so well and but"
DEMONSTRATIVES = "a an the this that these those"
SUBJECT_PRONOUNS = "i you we they he she it"
SHORT_SUBJECT_STARTS = "i you we they he she it this that those"
BARE_VERBS = "open build make take create turn move put bring keep hold push pull drive"
INDEPENDENT = ["yes", "no", "really", "right", "exactly", "okay", "ok"]
TRANSITION_PHRASES = [
    "so", "and", "but", "alternatively", "however", "therefore", "instead", "meanwhile", "in fact", "for example", "on the other hand",
]
HAN_DANGLING = "因为 如果 由于 对于 关于 以及 并且 而 但 把 将 意味着 导致 开始 正在"
HAN_BEFORE_TIME = "想 看 说 问 思考 考虑 引发 导致 发生 出现 结束"
