"""Word lists and label rules."""

from __future__ import annotations

from seekgrain.functions.unicode_rules import fold_character

# ---- Fixed values: stop words, technology words, phrases, concepts ----------------------------
FRENCH_STOPWORDS = (
    "a afin ainsi au aux avec ce ces cette comme dans de des du elle elles en est et il ils la le les "
    "leur leurs mais ne nous ou par pas plus pour que qui reference references sa se ses son sont sur "
    "tout toute toutes tous un une votre vous"
).split()
ENGLISH_STOPWORDS = (
    "a an and are as at be by for from in is it its of on or our reference references that the their "
    "these this those to was were which who with your"
).split()
ARABIC_STOPWORDS = (
    "أن إن إلى أو أي بعد بين تم ثم حول ذلك على عن في قبل كان كل كما لا لدى لن لم ما مع من "
    "هذا هذه هو هي التي الذي الذين"
).split()
ARABIC_PREFIXES = ("و", "ف")
ACRONYMS = "api si pca iam soc erp crm rgpd".split()
TECHNOLOGY_WORDS = (
    "api gateway kong azure iso 27001 rgpd kubernetes ipv6 cloud cobit itil sap iam soc erp crm"
).split()
PHRASES = (
    ("api gateway", "API Gateway", "technology"),
    ("iso 27001", "ISO 27001", "technology"),
    ("core banking", "Core banking", "technology"),
)
QUERY_CONCEPTS = {
    "business_continuity": (
        "pca",
        "pci",
        "plan continuite",
        "continuite activite",
        "business continuity",
        "استمراريه الاعمال",
        "استمرارية الاعمال",
    ),
    "api_management": ("api gateway", "api management", "kong"),
    "cloud": ("cloud", "infonuagique"),
    "cybersecurity": ("cybersecurite", "cybersecurity", "securite si", "امن المعلومات"),
}
CONCEPT_EVIDENCE = {
    "business_continuity": (
        "pca",
        "pci",
        "continuite activite",
        "business continuity",
        "استمراريه الاعمال",
        "استمرارية الاعمال",
    ),
    "api_management": ("api", "gateway", "kong"),
    "cloud": ("cloud", "infonuagique"),
    "cybersecurity": ("cyber", "securite", "security"),
}
FRENCH_HINTS = (
    "de la le les des du une et en pour dans sur avec au aux référence projet mission banque sécurité"
).split()
ENGLISH_HINTS = (
    "the of and to in for on with is are reference project bank security strategy implementation cloud"
).split()
FRENCH_ACCENTS = "[àâçéèêëîïôùûüÿœ]"

COUNTRIES = {
    "abidjan": ("Côte d’Ivoire", "CI"),
    "algerie": ("Algérie", "DZ"),
    "benin": ("Bénin", "BJ"),
    "burkina faso": ("Burkina Faso", "BF"),
    "cameroun": ("Cameroun", "CM"),
    "cote d ivoire": ("Côte d’Ivoire", "CI"),
    "france": ("France", "FR"),
    "libya": ("Libye", "LY"),
    "libye": ("Libye", "LY"),
    "mali": ("Mali", "ML"),
    "maroc": ("Maroc", "MA"),
    "mauritanie": ("Mauritanie", "MR"),
    "niger": ("Niger", "NE"),
    "rwanda": ("Rwanda", "RW"),
    "senegal": ("Sénégal", "SN"),
    "togo": ("Togo", "TG"),
    "tunise": ("Tunisie", "TN"),
    "tunisie": ("Tunisie", "TN"),
}
TECHNOLOGY_LABELS = (
    ("API management", ("api gateway", "api management", "kong")),
    ("Cloud", ("cloud", "infonuagique")),
    ("COBIT", ("cobit",)),
    ("Core banking", ("core banking",)),
    ("Data platform", ("data warehouse", "big data", "plateforme data", "lac de donnees")),
    ("Digital identity", ("identity and access", "gestion des identites", "iam")),
    ("ERP", ("enterprise resource planning", " erp ", "sap")),
    ("IPv6", ("ipv6",)),
    ("ITIL", ("itil", "service desk")),
    ("Network", ("reseau", "network", "vpn", "backbone")),
)
THEME_LABELS = (
    (
        "Audit technique et organisationnel",
        ("audit", "diagnostic", "etat des lieux", "evaluation de l existant"),
    ),
    (
        "Réingénierie des processus",
        ("reingenierie", "processus metier", "processus operationnel", "optimisation des processus"),
    ),
    (
        "Rédaction des cahiers des charges",
        ("cahier des charges", "specifications fonctionnelles", "specifications techniques", " rfp ", " rfi "),
    ),
    ("Réseaux et architecture", ("architecture", "reseau", "network", "infrastructure")),
    (
        "Sécurité des SI et interopérabilité",
        ("securite", "cyber", "interoperabilite", "pentest", "protection des donnees"),
    ),
    (
        "Accompagnement à la mise en place",
        ("mise en place", "mise en oeuvre", "deploiement", "assistance a maitrise d ouvrage", "amoa"),
    ),
    (
        "Conduite du changement",
        (
            "conduite du changement",
            "transfert de competences",
            "formation des utilisateurs",
            "accompagnement au changement",
        ),
    ),
)
DELIVERY_MARKERS = (
    "objet du contrat",
    "objet de la mission",
    "plan de continuite",
    "services rendus",
    "prestations",
    "accompagnement",
    "mise en place",
    "realisation de la mission",
    "project scope",
    "services delivered",
    "implementation",
    "business continuity",
    "نطاق المشروع",
    "الخدمات المقدمة",
    "استمرارية الاعمال",
    "تنفيذ المشروع",
)
LEGAL_MARKERS = (
    "confidentialite",
    "dommages et interets",
    "servir et valoir ce que de droit",
    "juridiction competente",
    "conditions generales",
    "resiliation du contrat",
)
CONTACT_PATTERN = (
    r"(?iu)(?:(?<![\p{L}\p{N}_])(?:t[ée]l(?:[ée]phone)?|fax|e-?mail|adresse|bo[iî]te\s+postale|bp)"
    r"(?![\p{L}\p{N}_])\s*[:.]|\[PHONE_LIKE\]|(?<![\p{L}\p{N}_])(?:fait\s+[àa]|en\s+foi\s+de\s+quoi|"
    r"(?:cette|la\s+pr[ée]sente)\s+attestation\s+est\s+d[ée]livr[ée]e|"
    r"il\s+y[’']?a(?:\s+eu)?\s+lieu\s+de\s+signaler|les\s+experts\s+ayant\s+particip[ée])"
    r"(?![\p{L}\p{N}_]))"
)
YEAR_PATTERN = r"(?<![\p{L}\p{N}_])(?:19|20)\p{Nd}{2}(?![\p{L}\p{N}_])"
ONGOING_PATTERN = (
    r"(?iu)(?<![\p{L}\p{N}_])(?:ongoing|present|présent|en\s+cours|actuel(?:le)?)(?![\p{L}\p{N}_])"
)
ALLOWED_SYMBOLS = ".,;:!?…'’\"“”()[]{}%€$£¥@&/+–—-·•°№#<>_=:"
# ---- end of fixed values ----------------------------------------------------------------------


def fold_word(word: str) -> str:
    return "".join(fold_character(char) for char in word)


STOPWORDS = sorted({fold_word(w) for w in FRENCH_STOPWORDS + ENGLISH_STOPWORDS + ARABIC_STOPWORDS})
