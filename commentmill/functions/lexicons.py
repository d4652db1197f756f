"""Fixed word lists. Every operator takes its own list as an argument; these are defaults."""

# The stop words used when no list is given.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is",
    "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with", "you", "your",
)

# Slang token -> phrase.
SLANG = {
    "u": "you", "ur": "your", "r": "are", "y": "why", "w": "with", "bc": "because",
    "b/c": "because", "cuz": "because", "cos": "because", "bcuz": "because", "pls": "please",
    "plz": "please", "thx": "thanks", "ty": "thank you", "np": "no problem",
    "idk": "I do not know", "idc": "I do not care", "imo": "in my opinion",
    "imho": "in my humble opinion", "tbh": "to be honest", "ngl": "not going to lie",
    "btw": "by the way", "fwiw": "for what it is worth", "irl": "in real life", "af": "as hell",
    "rn": "right now", "atm": "at the moment", "wbu": "what about you", "hbu": "how about you",
    "omg": "oh my god", "omfg": "oh my god", "lol": "laughing out loud", "lmao": "laughing hard",
    "lmfao": "laughing hard", "rofl": "laughing hard", "smh": "shaking my head",
    "ikr": "I know right", "ik": "I know", "fr": "for real", "sus": "suspicious",
    "lowkey": "somewhat", "highkey": "very", "ppl": "people", "abt": "about", "msg": "message",
    "dm": "direct message", "gf": "girlfriend", "bf": "boyfriend", "ne1": "anyone",
    "sum1": "someone", "nvm": "never mind", "jk": "just kidding", "jfc": "for crying out loud",
    "stfu": "shut up", "gtfo": "get out", "ffs": "for goodness sake", "wtf": "what the hell",
    "wth": "what the hell", "wya": "where you at", "wyd": "what you doing",
    "ttyl": "talk to you later", "omw": "on my way", "icymi": "in case you missed it",
    "ftw": "for the win", "fml": "I am upset", "tl": "too long", "dr": "did not read",
    "gonna": "going to", "wanna": "want to", "gotta": "got to", "kinda": "kind of",
    "sorta": "sort of", "prolly": "probably", "dunno": "do not know", "lemme": "let me",
    "gimme": "give me", "imma": "I am going to", "tryna": "trying to", "coulda": "could have",
    "woulda": "would have", "shoulda": "should have", "mighta": "might have",
    "musta": "must have", "doin": "doing", "goin": "going", "nothin": "nothing",
    "somethin": "something", "anythin": "anything", "everythin": "everything",
    "fav": "favorite", "pic": "picture", "obvi": "obviously", "def": "definitely",
    "abs": "absolutely", "govt": "government", "info": "information", "ima": "I am going to",
}

# Contraction -> phrase.
CONTRACTIONS = {
    "can't": "can not", "cannot": "can not", "won't": "will not", "i'm": "I am",
    "i've": "I have", "i'll": "I will", "i'd": "I would", "you're": "you are",
    "you've": "you have", "you'll": "you will", "you'd": "you would", "we're": "we are",
    "we've": "we have", "we'll": "we will", "we'd": "we would", "they're": "they are",
    "they've": "they have", "they'll": "they will", "they'd": "they would", "he's": "he is",
    "he'll": "he will", "he'd": "he would", "she's": "she is", "she'll": "she will",
    "she'd": "she would", "it's": "it is", "it'll": "it will", "it'd": "it would",
    "that's": "that is", "that'll": "that will", "there's": "there is", "here's": "here is",
    "what's": "what is", "who's": "who is", "where's": "where is", "how's": "how is",
    "when's": "when is", "why's": "why is", "isn't": "is not", "aren't": "are not",
    "wasn't": "was not", "weren't": "were not", "haven't": "have not", "hasn't": "has not",
    "hadn't": "had not", "doesn't": "does not", "didn't": "did not", "don't": "do not",
    "wouldn't": "would not", "couldn't": "could not", "shouldn't": "should not",
    "mightn't": "might not", "mustn't": "must not", "needn't": "need not", "ain't": "is not",
    "y'all": "you all", "ya": "you", "ye": "you",
}

# Tokens that hint at slang-heavy comments.
SLANG_HINTS = (
    "u", "ur", "r", "y", "pls", "plz", "thx", "idk", "tbh", "ngl", "lol", "lmao", "smh", "imo",
    "btw", "omg", "wtf", "gonna", "wanna", "kinda", "ima", "imma", "aint", "dunno",
)

# Double-quote-like glyphs (class body of a pattern).
QUOTE_GLYPHS = (
    r"\"\u201c\u201d\u201e\u201f\u2033\u2036\uff02\u301d\u301e\u275d\u275e\u3003\u00ab\u00bb"
)

# Invisible format characters (class body of a pattern).
INVISIBLE = r"\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff\u00ad\u034f\u061c"

# Default profanity terms, the suffixes that still count as a hit, the
# look-alike characters and the default replacements.
PROFANITY_TERMS = (
    "asshole", "bastard", "bitch", "bullshit", "crap", "cunt", "damn", "dick", "fuck",
    "motherfucker", "piss", "shit", "slut", "whore",
)
PROFANITY_SUFFIXES = ("'s", "s", "es", "ed", "ing", "er", "ers", "y", "ies")
LOOKALIKE_FROM = "@431!0$57"
LOOKALIKE_TO = "aaeiiosst"
PROFANITY_REPLACEMENTS = {
    "shit": "bad", "fuck": "bad", "bitch": "rude person", "asshole": "rude person",
    "dick": "rude person", "whore": "person", "slut": "person",
}
MASK_TOKEN = "[censored]"

# Vocabularies of a scorer's answer.
CATEGORIES = (
    "Hate Speech", "Harassment", "Profanity", "Violence", "Political Extremism",
    "Misinformation", "Racism", "Religious Hate", "Threats", "None",
)
LEVELS = ("Low", "Medium", "High", "Severe")
TOXICITY_TYPES = (
    "Insult", "Threat", "Identity Attack", "Profanity", "Extremist Language", "Bullying",
    "Graphic Violence", "Political Abuse", "Religious Intolerance",
)
SCORE_FIELDS = (
    "toxicity", "severe_toxicity", "identity_attack", "insult", "profanity", "threat",
)
SCORE_TITLES = {
    "toxicity": "Toxicity", "severe_toxicity": "Severe Toxicity",
    "identity_attack": "Identity Attack", "insult": "Insult", "profanity": "Profanity",
    "threat": "Threat",
}
