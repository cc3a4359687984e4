"""Patterns and word lists of the note contract. They must stay as they are for equal results."""

MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
TIME = r"(?i)\b(?:[01]?\d|2[0-3]):[0-5]\dZ?\b|\b(?:[01]\d|2[0-3])[0-5]\dZ\b"
DATE = r"(?i)\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}\s+" + MONTH + r"\s+\d{4}|" + MONTH + r"\s+\d{1,2},?\s+\d{4})\b"
PARTIAL_DATE = r"(?i)\b(?:\d{1,2}\s+" + MONTH + "|" + MONTH + r"\s+\d{1,2})\b"
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
REFERENCE = r"(?<!\w)[A-Z][A-Z0-9]{0,24}(?:[-_][A-Z0-9]{1,24})+(?!\w)"
NUMBER = r"(?<!\d)\d+(?::\d+)?(?!\d)"
INITIALS = r"\(([A-Z]{2,4})\)"
STATED_INITIALS = r"\b(?i:initials?)\s*:?\s*(?:(?i:were|are|was|is)\s+)?([A-Z]{2,4})\b"
ZONE = r"(?i)\b(?:UTC|GMT|EDT|EST|CDT|CST|MDT|MST|PDT|PST)\b|\d{4}Z\b|\d{2}:\d{2}Z\b"
SENTENCE = r"(?d)[^.!?\n]+(?:[.!?]+|$)"
#: All signs that count as white space, the separators of information among them.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The eleven line ends: LF, CR, VT, FF, FS, GS, RS, NEL, LS, PS, and CRLF as one.
LINE_END = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
WORD = r"[\p{L}\p{N}_]+"

UNCERTAIN = r"(?i)\b(?:unknown|unclear|uncertain|unconfirmed|unsure|maybe|possibly|not sure|not (?:yet )?(?:assessed|established|assigned|confirmed|known|resolved|verified|checked)|pending|awaiting|TBD|no impact reported|no one has told|don['’]t know|(?:do|does|did) not know|whether|no owner|not agreed)\b"
INSTRUCTION_LINE = r"(?i)^\s*(?:pasted (?:command|instruction)|prompt injection|instruction to (?:the )?(?:AI|model))\s*(?:\([^\n]*?\))?\s*:"
CONTROL = r"\b(?:ignore (?:all |the |previous |above |user['’]s )*(?:instructions?|format|rules)|(?:put|write|insert)\b[^.\n]{0,100}\bin (?:PLAN|ACTION|IMPACT)|(?:system|assistant)\s*:)\b"
NO_CONTACT = r"(?i)\b(?:none contacted|no agencies contacted|no contacts|not applicable|nobody contacted|no one contacted|(?:haven['’]t|have not|had not) (?:called|contacted|emailed)(?: or emailed)? anyone)\b"
AUTHOR_REQUEST = (
    r"(?i)^(?:please\s+)?(?:help (?:me|us)\b.*(?:draft|write|format|log|ask next)|(?:keep|make)\b.*(?:visible|readable)|(?:rewrite|reformat|summarize|organize) (?:this|these|the)\b|"
    r"(?:we |i )?need\b.*(?:readable|(?:clear|tidy|standardized|formatted|structured|concise|clean)\b.*\b(?:log|draft|entry))|"
    r"(?:fill in|add|suggest|recommend|propose)\b.*(?:possible impact|action and plan|next steps|ideas)|(?:the )?author (?:needs|wants|requests)\b.*(?:readable|rewrite|format)|do not (?:invent|fabricate))"
)
QUOTED_BLOCK = r"(?i)(?:(?:I|we) (?:copied|pasted|included) [^.!?\n]{0,160}?:\s*)?\[BEGIN ([^\]\n]+)\][\s\S]*?\[END \1\](?:\s*\.)?"
PROPOSAL_LABEL = r"(?i)^(?:(?:possible|potential|hypothetical|inferred) impact\s*:|(?:proposed|suggested|recommended) (?:follow[- ]?up|plan|action|next step)\s*:|consider\b|recommend\b)"
IMPERATIVE_FACT = r"(?i)^(Confirm|Ask|Check|Identify|Record|Contact|Review|Clarify|Arrange|Follow up|Await|Wait)\b"
ASSUMED_DEADLINE = r"(?i)\b(?:after|before|by|until|at)\s+(?:the|a|an|this|that)\b[^.!?\n]{0,45}\bdeadline\b"
NO_FURTHER = r"(?i)\b(?:no further action|no follow[- ]?up|no action (?:needed|required)|none required)\b"
UNAFFECTED = r"(?i)\b(?:no impact|unaffected|not affected)\b"
NOT_DELAYED = r"(?i)\b(?:no|not|never)\b.{0,35}\bdelay(?:ed|s)?\b"
SECTION_HEADING = r"(?i)^(?:SITUATION(?:\s*\([^)]*\))?|IMPACT|AGENCIES CONTACTED(?:\s*\([^)]*\))?|ACTION|PLAN)\s*:$"
EVENT_HEADING = r"(?is)^[ \t]*EVENT[ \t]*:[ \t]*(.*)$"

QUALIFIER = (
    r"\b(?:unknown|unclear|uncertain|unconfirmed|unsure|maybe|possibly|reportedly|apparently|allegedly|preliminary|estimated|may|might|could|seems?|appears?|believes?|thinks?|"
    r"not sure|not know|not known|not specify|not yet assessed|not assessed|not yet confirmed|not confirmed|not verified|no impact (?:was )?reported|"
    r"has not been (?:assessed|confirmed|verified)|can not (?:be identified|identify|tell)|could not tell)\b"
)
PROSPECTIVE = (
    r"\b(?:planned|planning|plans? to|intends? to|intended|will|would|should|must|needs? to|awaiting|pending|proposed|suggested|recommended|"
    r"(?:asked|requested|instructed)\b[^.;!?]{0,100}\bto|to be)\b"
)
COMPLETED = (
    r"\b(?:sent|checked|contacted|called|emailed|filed|submitted|approved|received|cancelled|canceled|resolved|completed|prepared|saved|updated|reviewed|"
    r"assigned|acknowledged|finished|closed|opened|confirmed|loaded|cleared|escalated|restored|notified|done|taken)\b"
)
IMPERATIVE = r"^(?:confirm|ask|check|identify|record|contact|review|clarify|arrange|follow up|await|wait|complete|update|send|save|prepare|file|notify|submit)\b"
NEGATIVE = r"\b(?:not|no|never|neither|nobody|nothing|without)\b"
NEGATIVE_QUALIFIER = r"\b(?:not (?:yet )?(?:sure|know|known|specify|assessed|confirmed|verified|clear|certain)|has not been (?:assessed|confirmed|verified)|not (?:only|just))\b"
BLANKET_ACTION = (
    r"\b(?:no (?:(?:other|further|additional) )?(?:actions?|work|steps?)\b[^.;!?]{0,32}\b(?:taken|done|performed|carried out)|"
    r"nothing (?:else )?(?:was |has been )?(?:done|taken))\b"
)
CONTACT = r"\b(?:contacts?|contacted|calls?|called|caller|replied|reply|responded|spoke|emailed|notified|initials?)\b"
CLAUSE_END = r"[;!?\n]+|\.(?:\s|$)|\s+(?:but|and|while)\s+|(?=\s+without\b)|,\s+(?=(?:i|we|he|she|they|it|the author|the source)\b)"

STOP_WORDS = (
    "a an the i we me us my our author operator person was were is are be been being has have had do does did to of for at on in with by and or but that this it "
    "its their his her they them he she as from then there said says stated states"
).split()
IMPACT_STOP_WORDS = (
    "the a an was were is are be been being may might could would have has had no not none any on of to for with at in and or but it this that there possible "
    "potential impact effect reported confirmed per by"
).split()
IRREGULAR = {
    "sent": "send", "sending": "send", "took": "take", "taken": "take", "done": "do", "made": "make", "got": "get", "told": "tell", "cancelled": "cancel", "canceled": "cancel",
    "cancelling": "cancel", "received": "receive", "receiving": "receive", "prepared": "prepare", "preparing": "prepare", "required": "require", "stopped": "stop",
    "stopping": "stop", "planned": "plan", "planning": "plan", "filed": "file", "filing": "file", "completed": "complete", "completing": "complete", "resolved": "resolve",
    "resolving": "resolve", "closed": "close", "closing": "close", "saved": "save", "saving": "save", "notified": "notify", "notifying": "notify", "delayed": "delay",
}

SECTIONS = ["situation", "impact", "agencies_contacted", "action", "plan"]
EVENT_TYPES = ["launch_report", "equipment_error", "conversation", "preventive_maintenance", "other"]
