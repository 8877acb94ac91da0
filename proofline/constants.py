"""Statuses, word lists, messages and limits.

These are data, not logic. Results only compare equal when they are spelled
exactly like this.
"""

# --- fixed values: lifecycle statuses ---------------------------------------
TRANSITIONAL = ("PENDING", "QUEUED", "PROCESSING")
FINISHED = ("COMPLETED", "REQUIRES_REVIEW")
SETTABLE = ("COMPLETED", "FAILED", "REQUIRES_REVIEW", "DUPLICATE")
CONFIRMED_SENDS = ("SENT", "MANUALLY_CONFIRMED")
UNCERTAIN_SENDS = ("SENDING", "UNKNOWN")
MAX_RETRIES = 5

# --- fixed values: reconciliation statuses, in anomaly report order ----------
CONFORM = "CONFORME"
ANOMALY_ORDER = (
    "DECLARE_WHATSAPP_ABSENT_DASHBOARD",
    "DASHBOARD_SANS_PREUVE_WHATSAPP",
    "ECART_DATE",
    "DOUBLON_WHATSAPP",
    "DOUBLON_DASHBOARD",
    "ID_ILLISIBLE",
    "DATE_ILLISIBLE",
    "SYNCHRONISATION_NON_CONFIRMEE",
    "ECHEC_SYNCHRONISATION",
    "ID_INCONNU",
    "MAUVAISE_APPLICATION",
    "VERIFICATION_MANUELLE",
)

# --- fixed values: report sheet of each reconciliation status ----------------
SHEET_OF_STATUS = {
    "CONFORME": "Correspondances",
    "DECLARE_WHATSAPP_ABSENT_DASHBOARD": "WhatsApp absents du dashboard",
    "DASHBOARD_SANS_PREUVE_WHATSAPP": "Dashboard sans preuve WhatsApp",
    "ECART_DATE": "Ecarts de date",
    "DOUBLON_WHATSAPP": "Doublons WhatsApp",
    "DOUBLON_DASHBOARD": "Doublons dashboard",
    "ECHEC_SYNCHRONISATION": "Synchronisations echouees",
    "ID_ILLISIBLE": "Preuves illisibles",
    "DATE_ILLISIBLE": "Preuves illisibles",
    "VERIFICATION_MANUELLE": "Verifications manuelles",
    "SYNCHRONISATION_NON_CONFIRMEE": "Verifications manuelles",
    "ID_INCONNU": "Verifications manuelles",
    "MAUVAISE_APPLICATION": "Verifications manuelles",
}
SHEET_SUMMARY = "Synthese"
SHEET_RAW_CLAIMS = "Donnees brutes WhatsApp"
SHEET_RAW_LEDGER = "Donnees brutes dashboard"
SHEET_CORRECTIONS = "Historique des corrections"

# --- fixed values: coverage priority, best first ------------------------------
COVERAGE_PRIORITY = ("SYNCHRONIZED", "REVIEW", "PENDING", "FAILED", "UNCONFIRMED")

# --- fixed values: problem reasons --------------------------------------------
REASON_ANALYSIS = "Analyse impossible : vérifier le fichier et renvoyer une capture nette"
REASON_UNREADABLE = "Image ou texte insuffisamment lisible"
REASON_NO_APPLICATION = "Application non identifiée"
REASON_NO_GROUP = "Identifiant du groupe absent ou illisible"
REASON_NO_DATE = "Date du rapport absente ou ambiguë"
REASON_SYNC_FAILED = "Synchronisation échouée"
REASON_SYNC_UNCONFIRMED = "Synchronisation non confirmée"
REASON_DEFAULT = "Preuve à vérifier avant confirmation"

# --- fixed values: extraction review reasons ----------------------------------
REVIEW_NO_ID = "Aucun identifiant de groupe detecte dans le texte OCR"
REVIEW_ID_UNSURE = "Format d'identifiant non reconnu avec certitude"
REVIEW_ID_CLOSE = "Correspondance floue ambigue avec les IDs connus (meilleur: %s, score %s)"
SURE_REPLACEMENT = 97
REVIEW_NO_DATE = "Aucun motif de date detecte dans le texte OCR"
REVIEW_BAD_DATE = "Le motif de date n'a pas pu etre interprete (probablement langue non supportee)"
REVIEW_NO_YEAR = "Annee absente et aucune date de contexte disponible : date non confirmee"
REVIEW_DEDUCED_YEAR = "Date deduite partiellement (annee absente sur la preuve)"
REVIEW_UNREADABLE = "Image insuffisamment lisible : renvoyer une capture nette de l'ecran complet"
REVIEW_SYNC = "Statut de synchronisation non confirme par mot-cle de succes ou d'echec"
READABLE_CONFIDENCE = 0.55

# --- fixed values: import row errors ------------------------------------------
ERROR_ID_MISSING = "ID du groupe manquant"
ERROR_ID_FORMAT = "Format d'ID de groupe invalide: '{}'"
ERROR_DATE_MISSING = "Date de synchronisation manquante"
ERROR_DATE_FORMAT = "Date illisible ou incomplete: '{}'"
EXPECTED_HEADER_WORDS = ("id", "group_id", "id_groupe", "identifiant")

# --- fixed values: application keyword defaults ---------------------------------
SUCCESS_KEYWORDS = (
    "synchronisation reussie", "synchronise", "donnees synchronisees",
    "synchronisation terminee", "termine", "succes", "success", "completed",
    "upload complete", "donnees envoyees",
)
ERROR_KEYWORDS = (
    "echec", "erreur", "connexion impossible", "synchronisation echouee",
    "failed", "error", "timeout", "donnees non envoyees",
)
TEXT_NOT_SYNCED = "Donnees non synchronisees"
TEXT_IN_PROGRESS = "Synchronisation en cours ou en attente"
TEXT_VALIDATED = "Synchronisation confirmee par validation manuelle"
KEYWORD_THRESHOLD = 85
SHORT_KEYWORD_THRESHOLD = 100
SHORT_KEYWORD_LENGTH = 14

# --- fixed values: patterns and characters of group ids -------------------------
ID_CANDIDATE = r"gr\s*[a-z0-9]{1,4}[\s.\-–—_]{1,3}[a-z0-9][a-z0-9\s\-–—_]{2,60}"
STANDALONE_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"
DASH_CHARS = "‐‑‒–—―_ "
DIGIT_LOOKALIKES = "oOiIlLsSbBzZ"
DIGIT_MEANINGS = "001111558822"

# --- fixed values: month words and date patterns ----------------------------------
MONTHS_FR = (
    "janvier", "fevrier", "février", "mars", "avril", "mai", "juin", "juillet",
    "aout", "août", "septembre", "octobre", "novembre", "decembre", "décembre",
)
MONTHS_EN = (
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)
MONTH_NUMBER = {
    "janvier": 1, "january": 1, "jan": 1,
    "fevrier": 2, "février": 2, "february": 2, "feb": 2,
    "mars": 3, "march": 3, "mar": 3,
    "avril": 4, "april": 4, "apr": 4,
    "mai": 5, "may": 5,
    "juin": 6, "june": 6, "jun": 6,
    "juillet": 7, "july": 7, "jul": 7,
    "aout": 8, "août": 8, "august": 8, "aug": 8,
    "septembre": 9, "september": 9, "sep": 9, "sept": 9,
    "octobre": 10, "october": 10, "oct": 10,
    "novembre": 11, "november": 11, "nov": 11,
    "decembre": 12, "décembre": 12, "december": 12, "dec": 12,
}

# --- fixed values: media and files ---------------------------------------------
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".3gp")
STORAGE_FOLDERS = ("uploads", "frames", "reports")
RETENTION_DAYS = 14
ATTACHMENT_WORDS = ("joint", "omitted", "omis", "<attached:", "piece jointe", "pièce jointe")
UNNAMED_ATTACHMENT = "__unnamed_attachment__"
MEDIA_NAME = r"(?i)([\w\-]+\.(?:jpg|jpeg|png|mp4|mov|webp|3gp|avi))"

# --- fixed values: reminder texts -----------------------------------------------
RECORDING_INSTRUCTIONS = (
    "Envoyez obligatoirement un enregistrement vidéo de l'écran (screen recording), "
    "réalisé directement avec la fonction Enregistrement d'écran du téléphone. "
    "Seules les vidéos d'enregistrement d'écran sont acceptées comme rapports. "
    "Il est interdit d'envoyer des selfies, des photos de vous-même, d'autres photos, "
    "des captures d'écran fixes ou tout autre contenu comme rapport. "
    "Ne filmez pas l'écran avec un deuxième téléphone : "
    "les reflets rendent les informations illisibles. "
    "Montrez l'application, l'identifiant du groupe, la date et la fin de la synchronisation "
    "avec son signe de réussite bien visible."
)
PRIVATE_CHAT_NOTICE = (
    "Ne répondez pas avec une vidéo ou une image dans ce chat privé. "
    "Envoyez vos autres rapports dans leurs groupes habituels."
)
DIGEST_OPENING = "Bonjour, voici vos rapports reçus le {} à corriger :"
DIGEST_CLOSING = (
    "Merci de renvoyer les preuves lisibles et synchronisées dans leur groupe WhatsApp d’origine."
)
DIGEST_MAX_CHARS = 4000
DIGEST_HOUR = 22
UNKNOWN_APPLICATION = "Application inconnue"
UNREADABLE_GROUP = "Groupe illisible"
UNKNOWN_AGENT = "Agent non identifié"
CUTOFF_NOTE = "Message antérieur à la remise à zéro ; non réimporté"
MISSING_FILE_NOTE = "Fichier media introuvable sur disque au moment du traitement backend"

# --- why an operational query cannot be answered -----------------------------------
SCOPE_NEEDS_PERIOD = "coverage needs a selected period"
SCOPE_OUT_OF_ORDER = "the period ends before it begins"
SCOPE_TOO_LONG = "the period is longer than the caller allows"

# --- fixed values: codes and texts of the rules for single applications ------------
COACH_SUFFIX = "coach"
CHECK_ONLY_CODES = ("watercoach", "yebcoach", "financecoach")
LABEL_CODE = "pfnlcoach"
LABELS = ("uploaddata", "telechargerlesdonnees")
NO_SUCCESS_WORDS_CODE = "agricoach"
TEXT_CHECK_VISIBLE = "eCoach : une coche de réussite visible suffit (Data facultatif)"
TEXT_LABEL_UNCONFIRMED = "PFNLCoach : premiere coche non confirmee"
CHECK_CONFIDENCE = 0.95

# --- fixed values: placeholders of a reminder --------------------------------------
APPLICATION_TO_STATE = "Application à préciser"
GROUP_TO_STATE = "Groupe à préciser"
DATE_TO_STATE = "Date à préciser"
ANSWER_IN_GROUP = "Renvoyez la correction dans le groupe WhatsApp d'origine."

# --- fixed values: words of a phone's own notification panel -----------------------
PANEL_RECORDER = ("enregistrement de l'ecran", "screen recording", "enregistrement d'ecran")
PANEL_SILENT = ("notifications silencieuses", "tout effacer")
PANEL_TILES = ("bluetooth", "mode avion", "airplane mode")
PANEL_CONTROLS = ("notifications", "effacer", "gerer", "clear all", "economiseur")

# --- fixed values: words that settle a status whatever else is said -----------------
NOT_DONE = r"\b(non synchronis\w*|pas synchronis\w*|not sync\w*|unsynced|not completed|non termine\w*)\b"
UNDER_WAY = r"\b(en cours|en attente|in progress|pending)\b"

# --- fixed values: what a date looks like; the first alternative at the leftmost place wins
DATE_PATTERN = (
    r"(?i)(\d{4}-\d{2}-\d{2}"
    r"|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}"
    rf"|\d{{1,2}}\s*,?\s*(?:{'|'.join(MONTHS_FR)})\.?\s*,?\s*\d{{0,4}}"
    rf"|\d{{1,2}}\s*,?\s*(?:{'|'.join(MONTHS_EN)})\.?\s*,?\s*\d{{0,4}})"
)
