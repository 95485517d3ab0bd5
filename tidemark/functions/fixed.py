"""Word lists, patterns and tables that results depend on."""

# Word boundaries by ASCII letters, digits and underscore: the patterns below
# are written for engines whose \\b knows only those.
WORD_START, WORD_END = r"(?<!\w)", r"(?!\w)"
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_words(pattern: str) -> str:
    """The pattern with each word boundary as the one-sided test that its
    neighbours allow, or as the two-sided one."""
    parts = pattern.split(r"\b")
    out = parts[0]
    for before, after in zip(parts, parts[1:]):
        if after[:1].isalnum() or after[:2] == r"\d":
            out += WORD_START
        elif before[-1:].isalnum() and after[:1] in ("", "|", ")", "["):
            out += WORD_END
        else:
            out += BOUNDARY
        out += after
    return out


# Finance lexicon.
POSITIVE_TERMS = tuple("""
beat beats exceeded outperform upgrade upgraded raised surge surged rally
rallied gain gains profit profitable growth expanding strong record high
bullish optimistic momentum breakthrough approval partnership acquisition
buyback dividend guidance-raise recovery rebound
""".split())
NEGATIVE_TERMS = tuple("""
miss missed misses downgrade downgraded cut cuts slash slashed plunge plunged
fell decline declined loss losses unprofitable shrinking weak bearish
pessimistic lawsuit investigation probe recall bankruptcy default layoffs
restructuring warning writedown impairment delisting fraud
""".split())
UNCERTAINTY_TERMS = tuple("""
uncertain uncertainty may might could possibly potential risk risks volatile
volatility unclear pending awaiting depends contingent speculative
""".split())
FORWARD_TERMS = tuple("""
will expects expected expect forecast forecasts forecasting guidance outlook
projected projects projecting upcoming plans planned anticipate anticipated
anticipates ahead future next upgrade target targets estimate estimates
""".split())
NOVELTY_STOP_WORDS = tuple("""
the a an and or but of to in for on at by with from as is are was were be
been being it its this that these those has have had will would could
should said says say new more than after over into about
""".split())
WORD = r"[a-z][a-z\-']+"
LONG_WORD = r"[a-z][a-z\-']{2,}"

# Stop words of the claim tokeniser.
CLAIM_STOP_WORDS = tuple((
    "a an and are as at be by for from has have in into is it its of on or that the to "
    "with using used within across via while over under after before during each "
    "including include includes than then this these those their they we our my i "
    "also both such other more most new work working").split())

# HTML entities.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))

# Instruction patterns, by name; all but the last ignore case.
REDACTION = "[REDACTED-INSTRUCTION]"
FENCE_OPEN, FENCE_CLOSE = "<<<JOB_POSTING_DATA", "JOB_POSTING_DATA>>>"
INSTRUCTION_PATTERNS = (
    ("override-instructions",
     r"\b(?:ignore|disregard|forget|override|bypass|skip)\b[^.\n]{0,40}?\b(?:above|prior|previous|earlier|prec(?:eding|edent)|all|any|original|system|initial)\b[^.\n]{0,40}?\b(?:instruction|instructions|prompt|prompts|rule|rules|direction|directions|context|guideline|guidelines)\b"),
    ("replacement-instructions",
     r"\b(?:new|updated|revised|real|actual|true)\s+(?:instruction|instructions|prompt|prompts|task|directive|directives)\b\s*:?"),
    ("role-marker",
     r"(?:^|\n)\s*(?:\[|\(|<|##\s*)?\s*(?:system|assistant|user|human|developer)\s*(?:\]|\)|>)?\s*:"),
    ("turn-token",
     r"<\|[^>\n]{0,40}\|>|</?(?:system|assistant|user|human)>"),
    ("persona-reset",
     r"\byou\s+(?:are|must\s+act|should\s+act|will\s+act|shall\s+act)\s+(?:now\s+)?(?:a|an|as)\b[^.\n]{0,60}"),
    ("prompt-exfiltration",
     r"\b(?:print|output|reveal|repeat|show|display|echo)\b[^.\n]{0,30}?\b(?:system\s+prompt|your\s+(?:prompt|instructions)|the\s+(?:prompt|instructions))\b"),
    ("fabrication-directive",
     r"\b(?:add|insert|include|invent|fabricate|claim|state)\b[^.\n]{0,40}?\b(?:experience|skills?|years?|degree|certification|qualification)s?\b[^.\n]{0,40}?\b(?:not|even\s+if|regardless|whether)\b[^.\n]{0,40}"),
    ("fence-escape", r"<<<JOB_POSTING_DATA|JOB_POSTING_DATA>>>"),
)

# Locations: bucket patterns (case ignored).
BUCKET_PATTERNS = {
    "calgary": (r"\bcalgary\b", r"\byyc\b"),
    "edmonton": (r"\bedmonton\b", r"\byeg\b"),
    "vancouver": (r"\bvancouver\b(?!\s*,?\s*(wa\b|washington))", r"\bburnaby\b", r"\brichmond\s*,?\s*bc\b"),
    "seattle": (r"\bseattle\b", r"\bbellevue\s*,?\s*wa\b", r"\bredmond\s*,?\s*wa\b", r"\bvancouver\s*,?\s*(wa\b|washington)"),
}
US_ABBR = r"(?:U\.S\.A?|USA?)"
US_RESTRICTED = (r"\b(?:" + US_ABBR + r"|[Uu]nited [Ss]tates)[\s-]*(?:only|based|residents?|citizens?)\b"
                 r"|\bmust be (?:located|based) in the (?:" + US_ABBR + r"|[Uu]nited [Ss]tates)\b")
SPONSORSHIP = r"\b(?:sponsor\w*|visa|work(?:ing)? authorization|work permit|h-?1b|tn visa|relocation (?:support|assistance))\b"
US_STATE_CODES = ("AL|AK|AZ|AR|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|"
                  "TX|UT|VT|VA|WA|WV|WI|WY")
US_STATE_NAMES = ("California|Colorado|Texas|New York|Washington|Oregon|Illinois|Massachusetts|Florida|Georgia|Arizona|Nevada|Utah|Virginia|"
                  "Maryland|Pennsylvania|New Jersey|Ohio|Michigan|Minnesota|Wisconsin|North Carolina")
US_LOCATION = r",\s*(?:" + US_STATE_CODES + r")\b|\b(?:" + US_STATE_NAMES + r")\b|\bUnited States\b|\bUSA\b"

# Remote work phrases.
CLAIMS_REMOTE = r"\bremote\b|\bwork from home\b|\bwfh\b|\banywhere\b|\bdistributed\b|\btelecommut\w*\b|t[ée]l[ée]travail"
FULLY_REMOTE = (
    r"\b(?:100%|fully|entirely|completely)\s*[- ]?\s*remote\b",
    r"\bremote[- ]?first\b",
    r"\bremote[- ]?only\b",
    r"\bwork from anywhere\b",
    r"\bpermanently remote\b",
)
HYBRID_BARE = r"\bhybrid\b"
HYBRID_SIGNALS = (
    r"\bhybrid\s+(?:role|position|job|opportunity|work(?:ing)?|model|schedule|arrangement|setup|policy)\b",
    r"\b(?:role|position|job)\s+is\s+hybrid\b",
    r"\bhybrid\s*\(\s*\d+\s*days?",
    r"\bthis is a hybrid\b",
    r"\b\d+\s*(?:\+\s*)?days?\s*(?:per|a|each|/)\s*week\s*(?:in|at|from)\s*(?:the\s*|our\s*)?office\b",
    r"\bin[- ]office\s*\d+\s*days?\b",
    r"\b\d+\s*days?\s*in[- ]office\b",
    r"\bmust\s+(?:be able to\s+)?(?:commute|come in(?:to)?|work from|travel)\s+(?:in\s+)?(?:to\s+)?(?:the\s+|our\s+)?office\b",
    r"\breturn[- ]to[- ]office\b",
    r"\bbased\s+(?:in|out of)\s+(?:our|the)\s+[\w\s]{0,30}office\b",
    r"\bexpected\s+to\s+be\s+on[- ]?site\b",
    r"\bon[- ]?site\s+presence\s+(?:is\s+)?required\b",
    r"\brelocation\s+(?:is\s+)?required\b",
    r"\bmust\s+(?:reside|live)\s+within\s+\d+\s*(?:km|kilometres|kilometers|miles)\b",
)
CANADA_SCOPE = (
    r"\bremote\b[^.]{0,40}\bcanada\b",
    r"\bcanada\b[^.]{0,40}\bremote\b",
    r"\banywhere in canada\b",
    r"\b(?:within|across|throughout)\s+canada\b",
    r"\bcanada[- ]wide\b",
    r"\bcanadian\s+(?:residents?|applicants?)\b",
    r"\bmust\s+(?:reside|be located|be based)\s+in\s+canada\b",
    r"\b(?:eligible|authorized|authorised)\s+to\s+work\s+in\s+canada\b",
    r"\bcanada\b",
)
US_NAME = r"(?:U\.S\.A?|USA?|United States)"
US_SCOPE_CASED = (
    r"\bremote\b[^.]{0,40}\b" + US_NAME + r"\b",
    r"\b" + US_NAME + r"[- ]?(?:only|based)\b",
    r"\bmust\s+(?:reside|be located|be based)\s+in\s+the\s+" + US_NAME + r"\b",
    r"\b(?:eligible|authorized|authorised)\s+to\s+work\s+in\s+the\s+" + US_NAME + r"\b",
    r"\banywhere in the " + US_NAME + r"\b",
)
US_SCOPE = (r"\bmust reside in the united states\b", r"\banywhere in the united states\b")
GLOBAL_SCOPE = (
    r"\banywhere in the world\b",
    r"\b(?:work|hire|hiring)\s+(?:from\s+)?(?:anywhere|globally|worldwide)\b",
    r"\bglobally distributed\b",
    r"\bany (?:country|location|timezone)\b",
)
DISCLAIMERS = (
    r"\bthese\s+do\s+not\s+apply\b",
    r"\bdo(?:es)?\s+not\s+apply\s+to\s+(?:the\s+)?[\w\s]{0,30}\b(?:program|fellowship|role|position)\b",
    r"\bthe\s+(?:below|following)\s+are\b[^.]{0,80}\bfor\s+full[- ]?time\s+roles\b",
)
REMOTE_TEXT = r"\bremote\b|t[ée]l[ée]travail|work from home|anywhere in canada"

# Experience requirement.
YEARS_MENTION = r"\b(\d+)\s*(?:-\s*(\d+)\s*)?\+?\s*years?\b(?:['’]s)?"
EXPERIENCE_CHARS = 60
EXPERIENCE_CAP = 2

# Status lifecycle.
TRANSITIONS = {
    "new": ("queued", "dismissed", "archived", "applied"),
    "queued": ("generating", "rejected", "queued", "dismissed", "new", "applied"),
    "generating": ("tailored", "queued"),
    "tailored": ("applied", "dismissed", "queued"),
    "rejected": ("new",),
    "dismissed": ("new",),
    "applied": (),
    "archived": ("new", "dismissed"),
}
REWORKABLE = ("new", "archived")

# Preferences used when none are given.
ROLE_KEYWORDS = ("software engineer", "software developer", "data engineer", "machine learning engineer", "developer")
PRIMARY_ROLES = ("software engineer", "software developer", "data engineer", "machine learning engineer")
SIMILAR_ROLES = ("developer",)
LEVEL_KEYWORDS = ("new grad", "new graduate", "entry level", "junior")
GRAD_KEYWORDS = ("new grad", "new graduate", "recent graduate", "graduate program", "early talent")
TIMING_KEYWORDS = ("jan 2027", "january 2027", "2027")
EXCLUDED_TITLES = ("senior", "staff", "principal", "lead", "director", "manager", "intern")
SYNONYMS = {"ml": "machine learning", "rl": "reinforcement learning"}
LOCATION_WEIGHTS = {"calgary": 0.5, "edmonton": 0.2, "remote": 0.15, "vancouver": 0.1, "seattle": 0.05}
SCORE_WEIGHTS = {"location": 0.65, "keyword": 0.35}
US_PENALTY = 0.35
SIMILAR_FACTOR = 0.7

# English stop words of the tf-idf branch.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
can will just don should now cannot could ought would
""".split()
