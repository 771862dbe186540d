"""Fixed values that decide which texts are kept and which words count."""

# English stop words (318).
STOP_WORDS = """
a about above across after afterwards again against all almost alone along already also although always am among
amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at
back be became because become becomes becoming been before beforehand behind being below beside besides between beyond
bill both bottom but by
call can cannot cant co con could couldnt cry
de describe detail do done down due during
each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except
few fifteen fifty fill find fire first five for former formerly forty found four from front full further
get give go
had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred
i ie if in inc indeed interest into is it its itself
keep
last latter latterly least less ltd
made many may me meanwhile might mill mine more moreover most mostly move much must my myself
name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere
of off often on once one only onto or other others otherwise our ours ourselves out over own
part per perhaps please put
rather re
same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone
something sometime sometimes somewhere still such system
take ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon these
they thick thin third this those though three through throughout thru thus to together too top toward towards twelve
twenty two
un under until up upon us
very via
was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever whether
which while whither who whoever whole whom whose why will with within without would
yet you your yours yourself yourselves
""".split()

# Section labels that mark the repeated part of a song.
CHORUS_LABELS = ["chorus", "hook", "refrain"]

# Fixed values: (artist, title) pairs that are never kept.
BLOCKLIST = [("ryo fukui", "my conception")]

# Phrases of scraped metadata, short list (plain phrases).
METADATA_NARROW = [
    "discogs", "bootleg", "remaster", "deluxe edition", "track listing", "work in progress",
]

# Phrases of scraped metadata, added in the long list.
METADATA_WIDE = METADATA_NARROW + [
    "genius japan", "genius annotation", "translated by", "translation by",
]
# Whole words; a trailing colon must be followed directly by a word character.
METADATA_WIDE_WORDS = ["producer", "release date"]
METADATA_WIDE_LABELS = ["album:", "label:"]

# Phrases of editorial prose.
PROSE_PHRASES = [
    "according to", "in an interview", "told reporters", "press release", "announced that",
    "the new york times", "rolling stone", "honorable mention", "on this track", "produced by",
    "sample from", "interpolates", "genius annotation", "this song", "the music video",
    "grand final", "applause", "laughter", "thank you all", "said to me",
]
# Phrases that need a pattern; \p{Nd} is a decimal digit in any script.  Each
# comes with the plain text that any match contains.
PROSE_PATTERNS = [
    (r"feat\.", "feat."),
    (r"\(\p{Nd}+p\)", "p)"),
    (r"semi.?final", "final"),
    (r"class of \p{Nd}{4}", "class of "),
    (r"chapter \p{Nd}", "chapter "),
]
# Phrases that must end at a word boundary.
PROSE_WORD_ENDS = ["he said", "she said", "replied", "murmured"]

# Length limits in tokens.
MIN_TOKENS_FULL = 50
SHORT_TOKENS_FULL = 30
MAX_TOKENS_FULL = 2000
MIN_TOKENS_CHORUS = 10

# Type-token gate.
TTR_WORDS = 200
TTR_MIN_WORDS = 100
TTR_MAX = 0.85

# Vocabulary size and minimum document frequency.
MAX_FEATURES = 10_000
MIN_DF = 2
