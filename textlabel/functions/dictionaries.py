"""Keyword lists, recode rules and stop words shipped with the package."""

from __future__ import annotations

# The nine outcomes.
OUTCOMES = [
    "Any Opioids",
    "Heroin",
    "Fentanyl",
    "Prescription.opioids",
    "Methamphetamine",
    "Cocaine",
    "Benzodiazepines",
    "Alcohol",
    "Others",
]

# Substance keywords per outcome, matched as substrings in any letter case. Misspellings,
# repeats and the trailing blanks are part of the lists and change what matches.
FENTANYL = ["fentanyl", "4-ANPP", "carfentanil", "actyelfentanyl"]
HEROIN = ["Heroin"]
PRESCRIPTION_OPIOIDS = [
    "Hydrocodone", "oxycodone", "hydromorphone", "oxymorphone", "codeine", "oxycontin", "methadone",
    "percocet", "buprenorphine", "meperidine", "morphine", "tapentadol", "tramadol", "naltrexone",
    "levorphanol",
]
ANY_OPIOIDS = [
    "fentanyl", "4-ANPP", "carfentanil", "actyelfentanyl", "heroin", "Hydrocodone", "oxycodone", "hydromorphone",
    "oxymorphone", "codeine", "oxycontin", "methadone", "percocet", "buprenorphine", "meperidine", "morphine",
    "tapentadol", "tramadol", "naltrexone", "levorphanol",
]
METHAMPHETAMINE = ["Methamphetamine"]
COCAINE = ["cocaine", "cocaethylene"]
BENZODIAZEPINES = [
    "Benzodiazapene", "etizolam", "chlordiazepoxide", "lorazepam", "flubromazolam", "nordiazepam",
    "diazepam", "pyrazolam", "clonazepam", "estazolam", "xanax", "alprazolam", "flualprazolam",
]
ALCOHOL = ["Alcohol", "ethanol", "ethanolism"]
OTHERS = [
    "Amphetamine",
    # anticonvulsants
    "Carbamazepine", "clobazam", "oxcarbazepine", "diazepam", "ethosuxamide", "phenytoin", "gabapentin",
    "lacosamide", "levetiracetam", "phenobarbital", "pregabalin", "lamotrigine", "topiramate", "valproate",
    "valproic acid", "zonisamide",
    # antidepressants
    "Citalopram", "fluoxetine", "fluvoxamine", "paroxetine", "sertraline", "buproprion", "venlafaxine",
    "duloxetine", "desvenlafasxine", "levomilnacipran", "imipramine", "desipramine", "nortriptyline", "doxepin",
    "trimipramine", "amoxapine", "protriptyline", "trazodone", "mirtazapine",
    # antihistamines
    "Diphenydramine", "cetirizine", "chlorpheniramine", "fexofenadine", "loratadine", "hydroxyzine", "doxylamine",
    "xylazine",
    # antipsychotics
    "Risperidone", "quetiapine", "olanzapine", "aripiprazole", "clozapine", "haloperidol", "chlorpromazine",
    "ziprasidone", "paliperidone", "trifluoperazine", "perphenazine", "fluphenazine", "lurasidone", "pimozide",
    # barbiturates
    "Butalbital", "phenobarbital ", "pentobarbital", "butabarbital", "amobarbital",
    # hallucinogens
    "Phencycldine", "LSD", "diethylamide", "ketamine", "PCP", "methylenedioxyamphetamine",
    # MDMA
    "3,4-methylenedioxymethamphetamine", "MDMA", "methylenedioxymethamphetamine", "3,4-methylenedioxymethaphetamine",
    # MDA
    "Methylenedioxyamphetamine", "methylenedioxyamphetamine ", "MDA",
    # muscle relaxants
    "Cyclobenzaprine", "baclofen", "carisoprodol", "metaxalone", "methocarbamol", "tizanidine", "orphenadrine",
]

SUBSTANCES = {
    "Any Opioids": ANY_OPIOIDS,
    "Heroin": HEROIN,
    "Fentanyl": FENTANYL,
    "Prescription.opioids": PRESCRIPTION_OPIOIDS,
    "Methamphetamine": METHAMPHETAMINE,
    "Cocaine": COCAINE,
    "Benzodiazepines": BENZODIAZEPINES,
    "Alcohol": ALCOHOL,
    "Others": OTHERS,
}

# Ordered rules for race and ethnicity. The first pattern found in the lower-cased value
# wins, so the order matters ("indian" hides the later "am. indian"; a "0" anywhere means unknown).
ASIAN = "Asian"
NATIVE = "American Indian or Alaska Native"
PACIFIC = "Native Hawaiian and Other Pacific Islander"
RACE_RULES = [
    ("white", "White"),
    ("black", "Black"),
    ("latino", "Latino"),
    ("hispanic", "Latino"),
    ("asian", ASIAN),
    ("chinese", ASIAN),
    ("filipino", ASIAN),
    ("cambodian", ASIAN),
    ("indian", ASIAN),
    ("japanese", ASIAN),
    ("korean", ASIAN),
    ("laotian", ASIAN),
    ("thai", ASIAN),
    ("vietnamese", ASIAN),
    ("nat amer", NATIVE),
    ("native american", NATIVE),
    ("am. indian", NATIVE),
    ("am. indian south", NATIVE),
    ("american indian", NATIVE),
    ("armenian", "Middle Eastern"),
    ("middle eastern", "Middle Eastern"),
    ("guamanian", PACIFIC),
    ("hawaiian", PACIFIC),
    ("pacific islander", PACIFIC),
    ("samoan", PACIFIC),
    ("multi-racial", "Multiracial"),
    ("multiracial", "Multiracial"),
    ("0", "Unknown"),
    ("null", "Unknown"),
    ("other", "Unknown"),
    ("unknown", "Unknown"),
]

# The public Snowball list of English stop words.
SNOWBALL_ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is
are was were be been being have has had having do does did doing would should could ought i'm you're
he's she's it's we're they're i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll
he'll she'll we'll they'll isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't didn't won't
wouldn't shan't shouldn't can't cannot couldn't mustn't let's that's who's what's here's there's when's
where's why's how's a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor
not only own same so than too very will
""".split()
