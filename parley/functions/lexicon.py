"""Word lists of the text rules. All of them are fixed values: results depend on every entry."""

# Words that count for a text's polarity.
POSITIVE_WORDS = [
    "happy", "great", "excellent", "wonderful", "love", "loved", "amazing", "fantastic", "good", "thanks", "thank",
    "appreciate", "appreciated", "perfect", "awesome", "delighted", "glad", "pleased", "enjoy", "enjoyed", "fine",
    "okay", "ok", "nice", "helpful", "satisfied", "smooth",
]
NEGATIVE_WORDS = [
    "hate", "hated", "terrible", "awful", "horrible", "bad", "worst", "angry", "furious", "frustrated", "annoyed",
    "upset", "disappointed", "sucks", "stupid", "ridiculous", "useless", "broken", "wrong", "unhappy", "miserable",
    "disgusting", "pathetic", "rude", "unacceptable", "lie", "lied", "lying", "complain", "complaining", "problem",
    "issue",
]
# Words that turn the polarity of what follows.
NEGATIONS = [
    "not", "no", "never", "n't", "dont", "doesnt", "isnt", "arent", "wont", "wasnt", "werent", "cant", "cannot",
    "didnt", "wouldnt", "shouldnt", "couldnt",
]
# Phrases of agreement and denial.
AFFIRMATIONS = [
    "yes", "yeah", "yep", "agree", "agreed", "absolutely", "definitely", "sure", "of course", "right", "correct",
    "indeed", "true",
]
DENIALS = ["no", "nope", "disagree", "disagreed", "never", "wrong", "false", "incorrect", "actually no"]
# Emotions by polarity.
NEGATIVE_EMOTIONS = ["angry", "frustrated", "anxious", "upset", "fear", "sad"]
POSITIVE_EMOTIONS = ["happy", "joy", "joyful", "content", "calm"]
NEUTRAL_EMOTIONS = ["neutral", "calm"]
