"""Rule tables, taxonomies and phrase lists.

These are data, not logic.  They have to equal the documented rules for results to
agree, so they are written out plainly and in their natural order.  Every operator
takes its table as a parameter; these are the defaults.
"""

from __future__ import annotations

from shelfmark.functions.rules import NameRule, Rule

# Default path rules (priority, then order, decides).
PATTERN_RULES = [
    Rule("script_files", "technical_script", 0.98, 95,
         extension=r"^(ps1|py|js|ts|jsx|tsx|sh|bat|cmd|vbs|rb|php|go|rs|swift|kt)$"),
    Rule("config_files", "technical_config", 0.98, 95,
         extension=r"^(json|yml|yaml|xml|ini|conf|config|toml|properties|cfg)$"),
    Rule("dotenv_files", "technical_config", 0.98, 95, file=r"^\.env(\..+)?$"),
    Rule("career_documents", "personal_career", 0.95, 95,
         file=r"(resume|cv|cover[-_]letter|job[-_]application|benefits.*guide|staff.*benefits)"),
    Rule("financial_documents", "financial_document", 0.95, 95,
         file=r"(invoice|receipt|tax|1099|w-2|statement|paystub|paycheck)"),
    Rule("screenshots", "media_screenshot", 0.95, 95,
         file=r"(screenshot|capture|screen.*shot).*\.(png|jpg|jpeg)"),
    Rule("markdown_tech", "technical_documentation", 0.95, 85,
         extension=r"^(md|markdown|rst|adoc|asciidoc)$",
         context=r"(commit|pr|pull[-_]request|git|sandbox|migration|api|readme|documentation|guide)"),
    Rule("markdown_general", "technical_documentation", 0.90, 80,
         extension=r"^(md|markdown|rst|adoc|asciidoc)$",
         exclude=r"(bmw|e\d{2}|f\d{2}|vehicle|axle|transmission|engine|brake|service)"),
    Rule("spreadsheets", "business_spreadsheet", 0.90, 85,
         extension=r"^(xlsx|xls|csv)$", exclude=r"(vehicle|bmw|car|service|repair|diagnostic)"),
    Rule("legal_documents", "legal_document", 0.90, 85,
         file=r"(contract|agreement|reporting|compliance|foreign.*contact|entry.*appearance|legal|court)"),
    Rule("cad_files", "design_cad", 0.95, 85, extension=r"^(dwg|dxf|skp|step|stp|iges|prt|asm|sldprt)$"),
    Rule("vector_graphics", "design_vector", 0.85, 85, extension=r"^(eps|ai|svg)$"),
    Rule("photoshop_files", "design_photoshop", 0.90, 85, extension=r"^psd$"),
    Rule("video_files", "media_video", 0.95, 80, extension=r"^(mp4|avi|mov|mkv|wmv|flv|webm)$"),
    Rule("audio_files", "media_audio", 0.95, 80, extension=r"^(mp3|wav|flac|aac|ogg|m4a|wma)$"),
    Rule("image_logo", "media_graphic", 0.90, 85, file=r"(logo|icon|avatar).*\.(png|jpg|jpeg|gif|svg|webp)$"),
    Rule("image_general", "media_image", 0.80, 75, extension=r"^(jpg|jpeg|png|webp|heic|bmp|gif|tiff)$"),
    Rule("pdf_financial", "financial_document", 0.90, 80, extension=r"^pdf$",
         context=r"(invoice|receipt|order.*#|statement.*#)"),
    Rule("pdf_technical", "technical_documentation", 0.85, 78, extension=r"^pdf$",
         context=r"(manual|guide|tutorial|reference.*guide|quick.*guide|user.*manual)"),
    Rule("pdf_health", "personal_health", 0.90, 78, extension=r"^pdf$", context=r"(yoga|exercise|health|fitness)"),
    Rule("pdf_general", "document_pdf", 0.70, 70, extension=r"^pdf$"),
    Rule("word_health", "personal_health", 0.90, 78, extension=r"^(docx|doc)$", context=r"(yoga|exercise|health)"),
    Rule("word_career", "personal_career", 0.95, 80, extension=r"^(docx|doc)$", context=r"(resume|cv)"),
    Rule("word_general", "document_word", 0.75, 70, extension=r"^(docx|doc)$"),
    Rule("presentation_career", "personal_career", 0.90, 78, extension=r"^(pptx|ppt|key|odp)$",
         context=r"(about.*me|resume|portfolio)"),
    Rule("presentation_general", "business_presentation", 0.85, 75, extension=r"^(pptx|ppt|key|odp)$"),
    Rule("database_files", "technical_database", 0.90, 75, extension=r"^(db|sqlite|sqlite3|mdb|accdb)$"),
    Rule("archives", "archive", 0.90, 75, extension=r"^(zip|rar|7z|tar|gz|bz2)$"),
    Rule("web_fonts", "web_font", 0.95, 75, extension=r"^(ttf|otf|woff|woff2|eot)$"),
    Rule("html_bookmarks", "web_bookmark", 0.95, 78, extension=r"^html?$",
         context=r"(bookmark|favorite|export|consolidate)"),
    Rule("html_general", "web_page", 0.85, 72, extension=r"^html?$"),
    Rule("css_files", "web_stylesheet", 0.90, 75, extension=r"^css$"),
    Rule("log_files", "technical_log", 0.90, 75, extension=r"^log$"),
    Rule("text_readme", "technical_documentation", 0.85, 75, extension=r"^txt$", context=r"(readme|license)"),
    Rule("text_general", "document_text", 0.70, 65, extension=r"^txt$"),
    Rule("software_installers", "software_installer", 0.90, 75,
         extension=r"^(exe|msi|dmg|pkg|deb|rpm|appimage)$", exclude=r"(bmw|vehicle|diagnostic|obd)"),
]

# Stored rules (rule_name, pattern, document_type, priority).
STORED_RULES = [
    ("financial_invoice_pattern", r"invoice|bill|receipt|payment", "financial_invoice", 90),
    ("automotive_technical_pattern", r"bmw|audi|mercedes|technical|manual|schematic", "automotive_technical", 90),
    ("hr_resume_pattern", r"resume|cv|curriculum|vitae", "hr_resume", 95),
    ("tax_document_pattern", r"tax|1040|w2|w-2|1099", "tax_document", 100),
]

# Comprehensive name rules; the last number is the order (1 first).
COMPREHENSIVE_RULES = [
    NameRule("Automotive - BMW E-Series Technical", "automotive_technical", 0.98,
             (r"3'\s*E\d{2}\s+\d{3}i", r"E\d{2}\s+[A-Z]\d+\b", r"F\d{2}\s+[A-Z0-9]+"), 1),
    NameRule("Automotive - BMW Parts/Systems", "automotive_technical", 0.95,
             (r"(?:transmission|gearshift|oil\s+pan|drive|output)", r"GA6L45R",
              r"(?:belt\s+drive|generator|AC|power\s+steering)",
              r"(?:headlight|fog\s+light|turn\s+indicator|rear\s+light)",
              r"(?:cooling|water\s+hose|thermostat)", r"(?:brake|suspension|axle)"), 1,
             (r"yoga", r"meditation", r"chapter")),
    NameRule("Automotive - Service Manuals", "automotive_technical", 0.93,
             (r"(?:service|repair|maintenance).*(?:manual|guide|instruction)",
              r"parts?\s+(?:diagram|manual|catalog)", r"BMW.*(?:technical|service|repair)"), 1),
    NameRule("Automotive - Diagnostic Reports", "automotive_service", 0.98,
             (r"\[?P\d{6}\]?.*(?:vehicle|diagnostic)", r"vehicle\s+diagnostic\s+report",
              r"(?:measuring|checking).*(?:ride|level|height).*vehicle"), 1),
    NameRule("Automotive - CARFAX", "automotive_service", 1.00, (r"CARFAX", r"vehicle\s+history\s+report"), 1),
    NameRule("Automotive - VIN Documents", "automotive_service", 0.90, (r"\b[A-HJ-NPR-Z0-9]{17}\b",), 1),
    NameRule("Automotive - BMW Model Specific", "automotive_technical", 0.90,
             (r"BMW\s+(?:M3|M5|M6|328i|335i|535i|X5|X3)", r"\d{4}.*BMW"), 1),
    NameRule("Personal - Own Resumes/CVs", "personal_career", 0.98,
             (r"%Resume[_-]CV", r"resume[-_]cv[-_]\d{8}", r"Resume[-_]CV[-_]v\d+",
              r"CL\.(?:Jan|Nov|Dec|Oct)\d{2}", r"CLv\d+\.(?:Jan|Nov|Dec)", r"Cover\s+Letter\s+\d{8}"), 2),
    NameRule("Personal - Yoga/Meditation Journals", "personal_journal", 1.00,
             (r"Chapter.*(?:Yoga|Patanjali|Sukha|Mantra|Ashtanga)", r"(?:Yoga|Meditation).*(?:Sutras|Shala)",
              r"Eight\s+Limbs.*Ashtanga", r"Sukha[-_]Shala"), 2),
    NameRule("Personal - Essays/Scholarship", "personal_essay", 1.00,
             (r"(?:AIAA|CSMP).*(?:Scholarship|Essay)", r"Career\s+Goals",
              r"Scholarship.*(?:Goals|Essay|Application)"), 2),
    NameRule("Personal - Career Tools", "personal_career_tool", 0.95,
             (r"salary[-_]estimator", r"compensation[-_]calculator", r"career[-_](?:planner|tool)"), 2),
    NameRule("Personal - Financial Calculators", "personal_finance_tool", 0.95,
             (r"mortgage[-_](?:calculator|comparison)", r"Down.*Conventional.*Mortgage",
              r"(?:loan|payment)[-_]calculator"), 2),
    NameRule("Technical - Product Manuals", "technical_manual", 0.90,
             (r"(?:instruction|installation|user)[-_\s]manual", r"RS[-_]\d{2}K.*(?:manual|instruction)",
              r"(?:product|equipment).*manual"), 3),
    NameRule("Technical - BMW Training Modules", "technical_documentation", 0.95,
             (r"ST\d{4}.*BMW", r"ST\d{4}.*(?:training|module|course)"), 3),
    NameRule("Technical - Configuration Files", "technical_config", 0.85,
             (r"\.(?:json|yml|yaml|xml|conf|config)$", r"(?:config|configuration).*\.(?:json|txt)"), 3),
    NameRule("Business - Real Estate Listings", "realestate_listing", 0.90,
             (r"\d{4}_-_\d{4}_\w+.*(?:suite|flyer)", r"(?:property|listing).*(?:flyer|brochure)"), 4),
    NameRule("Business - Proposals", "business_proposal", 0.90,
             (r"(?:business|project)[-_\s]plan", r"proposal.*\d{8}"), 4),
    NameRule("Medical - Healthcare Directives", "medical", 0.95,
             (r"(?:health\s+care|healthcare)\s+directive",
              r"(?:blue\s+cross|medical|healthcare).*(?:directive|consent)"), 5,
             (r"vehicle", r"BMW", r"diagnostic\s+report")),
    NameRule("Medical - Bills/Records", "medical_bill", 0.90,
             (r"SB[-_]\d{8}[-_]\d{4}", r"(?:medical|patient).*(?:bill|invoice|record)"), 5, (r"vehicle", r"BMW")),
    NameRule("Communications - Product Brochures", "technical_documentation", 0.85,
             (r"3M_EU_IB", r"(?:brochure|catalog|datasheet)", r"Dryconn.*Connectors"), 6),
    NameRule("Communications - Emails", "communication_email", 0.90,
             (r"[-_]email\.pdf$", r"(?:employee|award).*nomination"), 6),
    NameRule("Financial - Order Numbers", "financial_invoice", 0.92,
             (r"Order\s+R\d{9}", r"(?:invoice|order)[-_\s]#?\d{6,}"), 7),
    NameRule("Financial - Statements", "financial_statement", 0.90,
             (r"statement[-_]\d{8}[-_]\d{8}", r"(?:bank|account).*statement"), 7),
    NameRule("HR - Job Listings", "hr_job_listing", 0.90,
             (r"(?:job|position).*(?:description|listing)", r"(?:engineer|developer).*Job\s+ID"), 8,
             (r"resume[-_]cv", r"Cover\s+Letter")),
    NameRule("Legal - Contracts", "legal_contract", 0.88,
             (r"(?:contract|agreement).*\d{8}", r"(?:employment|vendor).*(?:contract|agreement)"), 9),
    NameRule("Review Required - CCO Files", "unknown", 0.40, (r"\d{4}-\d{2}-\d{2}_review_cco_\d{6}",), 10),
    NameRule("Screenshots", "screenshot", 1.00,
             (r"Screenshot\s+\d{4}-\d{2}-\d{2}", r"Capture\.(?:PNG|png)"), 11),
]

# Simple name rules, tried in the order written.
SIMPLE_RULES = [
    NameRule("Vehicle diagnostic report pattern", "automotive_service", 0.95,
             (r"\[?P\d{6}\]?\s*Vehicle\s+Diagnostic", r"Vehicle\s+Diagnostic\s+Report",
              r"Diagnostic\s+Report.*\d{8}")),
    NameRule("BMW technical documentation", "automotive_technical", 0.95,
             (r"BMW\s+[A-Z0-9]+,?\s*\d+kW", r"BMW.*(?:Engine|Transmission|Chassis)",
              r"\b[E|F]\d{2}\s+[A-Z0-9]+\b", r"ST\d{4}.*BMW")),
    NameRule("Automotive service manual", "automotive_technical", 0.90,
             (r"(?:Service|Repair|Maintenance).*(?:Manual|Instruction|Guide)", r"Parts?\s+(?:Diagram|Manual|List)",
              r"(?:Engine|Transmission|Brake|Suspension).*(?:Service|Repair)",
              r"Measuring.*(?:ride|level|height).*vehicle", r"(?:Oil|Coolant|Fluid).*(?:Service|Change|Top)",
              r"AIR\s*-\s*Repair\s+instruction")),
    NameRule("CARFAX vehicle history report", "automotive_service", 1.00,
             (r"CARFAX", r"Vehicle\s+History\s+Report")),
    NameRule("Contains VIN number", "automotive_service", 0.85, (r"\b[A-HJ-NPR-Z0-9]{17}\b",)),
    NameRule("Personal resume/CV (not HR recruiting)", "personal_career", 0.95,
             (r"(?:Resume|CV)[-_](?:CV|resume)", r"%Resume_CV", r"resume-cv_\d{8}", r"CL\.(?:Jan|Nov|Dec)\d{2}")),
    NameRule("Personal cover letter (not HR recruiting)", "personal_career", 0.95, (r"Cover\s+Letter\s+\d{8}",)),
    NameRule("Yoga/meditation journal entry", "personal_journal", 1.00,
             (r"Chapter.*(?:Yoga|Patanjali|Sukha|Mantra)", r"(?:Yoga|Meditation).*(?:Sutras|Shala)",
              r"Eight\s+Limbs.*Ashtanga")),
    NameRule("Personal essay/career goals", "personal_essay", 1.00,
             (r"AIAA\s+Scholarship", r"CSMP_ESSAY", r"Career\s+Goals")),
    NameRule("Technical training module", "technical_documentation", 0.90,
             (r"ST\d{4}.*(?:Training|Module|Course)", r"(?:Training|Module).*(?:Manual|Guide)")),
    NameRule("Business plan document", "business_proposal", 0.95, (r"Business[-_\s]Plan",)),
    NameRule("Generic CCO file - needs manual review", "unknown", 0.50,
             (r"\d{4}-\d{2}-\d{2}_review_cco_\d{6}", r"cco_\d{6}")),
]

# Keyword groups of the fallback classifier, and its extension map.
KEYWORD_GROUPS = [
    (("invoice", "payment", "amount", "total", "tax"), "financial_document"),
    (("bank", "statement", "balance", "transaction"), "financial_statement"),
    (("budget", "expense", "revenue", "profit"), "business_spreadsheet"),
    (("import", "def ", "class ", "function", "return"), "technical_script"),
    (("config", "settings", "options", "parameter"), "technical_config"),
    (("#include", "typedef", "struct", "extern"), "source_header"),
    (("resume", "experience", "education", "skills"), "personal_document"),
    (("contract", "agreement", "party", "terms"), "legal_document"),
    (("meeting", "agenda", "minutes", "action items"), "business_document"),
]
KEYWORD_EXTENSIONS = {
    ".py": "technical_script",
    ".js": "technical_script",
    ".h": "source_header",
    ".c": "technical_script",
    ".xlsx": "business_spreadsheet",
    ".pdf": "document",
    ".docx": "document",
}

# Content rules (name, keywords, required hits, type, confidence).
CONTENT_RULES = [
    ("Invoice Detection", ("invoice", "bill to", "amount due", "payment terms", "total amount"),
     2, "financial_invoice", 0.95),
    ("Bank Statement Detection",
     ("account number", "statement period", "beginning balance", "ending balance", "deposits"),
     3, "financial_statement", 0.95),
    ("Tax Document Detection",
     ("form 1040", "form w-2", "tax year", "internal revenue", "social security number"), 2, "tax_document", 0.98),
    ("Contract Detection", ("this agreement", "whereas", "parties agree", "in witness whereof", "executed"),
     3, "legal_contract", 0.90),
    ("Court Document Detection", ("court", "docket", "plaintiff", "defendant", "case number", "judicial"),
     3, "legal_court", 0.92),
    ("Medical Record Detection",
     ("patient", "diagnosis", "physician", "medical history", "prescription", "vital signs"), 3, "medical", 0.93),
    ("Vehicle Service Detection", ("vehicle", "service", "repair", "maintenance", "mileage", "diagnostic"),
     3, "automotive_service", 0.88),
    ("Vehicle Manual Detection",
     ("owner manual", "vehicle operation", "maintenance schedule", "specifications", "warranty"),
     2, "automotive_technical", 0.90),
    ("Resume Detection", ("experience", "education", "skills", "objective", "references", "employment"),
     3, "hr_resume", 0.85),
    ("Technical Manual Detection",
     ("technical specifications", "installation", "configuration", "troubleshooting", "system requirements"),
     3, "technical_manual", 0.87),
]

# Search domains and their keywords.
DOMAIN_KEYWORDS = {
    "automotive": ("vehicle", "car", "automotive", "bmw", "mercedes", "audi", "engine", "transmission", "service",
                   "repair", "manual", "vin", "carfax", "diagnostic", "maintenance", "parts"),
    "medical": ("medical", "patient", "doctor", "hospital", "clinic", "diagnosis", "treatment", "prescription",
                "healthcare", "physician", "surgery", "symptoms"),
    "financial": ("invoice", "payment", "receipt", "statement", "transaction", "account", "bank", "finance",
                  "billing", "charge"),
    "legal": ("contract", "agreement", "legal", "court", "case", "attorney", "law", "settlement", "litigation",
              "lawsuit"),
    "personal": ("resume", "cv", "cover letter", "career", "job", "application", "personal", "yoga", "meditation",
                 "journal"),
    "technical": ("technical", "documentation", "manual", "guide", "training", "module", "configuration",
                  "software", "hardware"),
}

# Description keywords -> (type, confidence), tried in order.
DESCRIPTION_TYPES = [
    (("code", "terminal", "programming", "script", "syntax"), "media_screenshot_code", 0.85),
    (("chart", "graph", "visualization", "plot", "data vis"), "media_screenshot_dataviz", 0.85),
    (("invoice", "receipt", "bill", "payment", "total $", "amount due"), "financial_invoice", 0.90),
    (("diagram", "schematic", "blueprint", "circuit", "flowchart"), "design_diagram", 0.85),
    (("screenshot", "application", "user interface", "window"), "media_screenshot", 0.80),
    (("photo", "photograph", "picture of", "showing"), "media_image", 0.75),
    (("document", "text", "page", "paragraph"), "scanned_document", 0.75),
]

# Name and content indicators per domain.
DOMAIN_INDICATORS = {
    "automotive": {
        "name": (r"\b(BMW|Mercedes|Audi|Ford|Toyota|Honda)\b",
                 r"\b(Parts?|Service|Manual|Diagnostic|Engine|Transmission)\b", r"\bE\d{2}\b", r"\bM\d{1,2}\b"),
        "content": (r"\b(VIN|Vehicle Identification)\b", r"\b(Engine Code|Chassis)\b",
                    r"\b(Service Record|Maintenance)\b"),
    },
    "financial": {
        "name": (r"\b(Invoice|Receipt|Statement|Bill)\b", r"\$\d+"),
        "content": (r"\b(Invoice Number|Order Number)\b", r"\b(Total|Subtotal|Tax)\b.*\$"),
    },
    "legal": {
        "name": (r"\b(Contract|Agreement|Court|Legal)\b",),
        "content": (r"\b(Party|Parties|Whereas)\b", r"\b(Case Number|Docket)\b"),
    },
}

# Extensions per (category, subcategory).  Where an extension stands twice the
# later one counts.  Other taxonomies come from a file: sources.tabular.read_taxonomy.
TAXONOMY = {
    ("documents", "text_documents"): (".txt", ".rtf", ".md", ".markdown", ".log", ".csv", ".tsv"),
    ("documents", "word_processing"): (".doc", ".docx", ".odt", ".pages", ".wpd", ".wps"),
    ("documents", "spreadsheets"): (".xls", ".xlsx", ".xlsm", ".xlsb", ".ods", ".numbers", ".gnumeric"),
    ("documents", "presentations"): (".ppt", ".pptx", ".pps", ".ppsx", ".odp", ".key"),
    ("documents", "pdfs"): (".pdf",),
    ("documents", "ebooks"): (".epub", ".mobi", ".azw", ".azw3", ".fb2", ".lit", ".lrf", ".cbr", ".cbz"),
    ("documents", "notes"): (".one", ".onenote", ".note", ".enex", ".nb"),
    ("media", "photos"): (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif", ".raw", ".cr2", ".nef", ".arw", ".dng"),
    ("media", "vector_graphics"): (".svg", ".ai", ".eps", ".ps", ".cdr", ".emf", ".wmf"),
    ("media", "videos"): (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg", ".3gp", ".ogv", ".vob", ".mts", ".m2ts"),
    ("media", "audio"): (".mp3", ".wav", ".flac", ".aac", ".m4a", ".ogg", ".wma", ".opus", ".ape", ".alac", ".aiff"),
    ("media", "graphics_projects"): (".psd", ".xcf", ".kra", ".clip", ".sai", ".psb", ".sketch", ".fig", ".xd"),
    ("code", "source_code"): (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".cpp", ".c", ".h", ".hpp", ".cs", ".rb", ".go", ".rs", ".php", ".swift", ".kt", ".scala", ".r", ".m", ".mm"),
    ("code", "web"): (".html", ".htm", ".css", ".scss", ".sass", ".less", ".vue", ".svelte", ".asp", ".aspx", ".jsp"),
    ("code", "scripts"): (".sh", ".bash", ".zsh", ".fish", ".ps1", ".bat", ".cmd", ".vbs", ".ahk"),
    ("code", "config"): (".json", ".yaml", ".yml", ".toml", ".ini", ".conf", ".cfg", ".env", ".properties", ".xml"),
    ("code", "notebooks"): (".ipynb", ".rmd", ".qmd"),
    ("code", "sql"): (".sql", ".sqlite", ".db", ".mdb", ".accdb"),
    ("archives", "compressed"): (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz", ".lz", ".lzma", ".z"),
    ("archives", "tar_archives"): (".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz"),
    ("archives", "disk_images"): (".iso", ".img", ".dmg", ".vhd", ".vhdx", ".vmdk", ".qcow2"),
    ("executables", "windows_executables"): (".exe", ".msi", ".dll", ".sys", ".bat", ".cmd", ".com", ".scr"),
    ("executables", "linux_binaries"): (".so", ".deb", ".rpm", ".appimage", ".snap", ".flatpak"),
    ("executables", "macos_binaries"): (".app", ".dmg", ".pkg", ".dylib", ".bundle"),
    ("executables", "installers"): (".msi", ".exe", ".pkg", ".deb", ".rpm", ".run"),
    ("design", "cad"): (".dwg", ".dxf", ".dgn", ".stl", ".step", ".stp", ".iges", ".igs", ".obj", ".fbx", ".3ds", ".blend", ".max", ".c4d"),
    ("design", "design_projects"): (".indd", ".idml", ".afdesign", ".afphoto", ".afpub"),
    ("email", "email_messages"): (".eml", ".msg", ".emlx", ".mbox"),
    ("email", "email_databases"): (".pst", ".ost", ".nsf", ".dbx"),
    ("virtual_machines", "vm_disks"): (".vmdk", ".vdi", ".vhd", ".vhdx", ".qcow2", ".hdd"),
    ("virtual_machines", "vm_configs"): (".vmx", ".ovf", ".ova", ".vbox"),
    ("virtual_machines", "containers"): (".dockerfile", ".docker"),
    ("fonts", "truetype"): (".ttf", ".ttc"),
    ("fonts", "opentype"): (".otf",),
    ("fonts", "web_fonts"): (".woff", ".woff2", ".eot"),
    ("system", "temp_files"): (".tmp", ".temp", ".cache", ".bak", ".old", ".~*"),
    ("system", "logs"): (".log", ".trace", ".out", ".err"),
    ("system", "system_files"): (".sys", ".ini", ".dat", ".dll", ".ico", ".lnk"),
    ("backups", "backup_archives"): (".bak", ".backup", ".old", ".save"),
    ("backups", "time_machine"): (".sparsebundle", ".backupbundle"),
    ("databases", "sqlite"): (".db", ".sqlite", ".sqlite3", ".db3"),
    ("databases", "other_dbs"): (".mdb", ".accdb", ".fdb", ".gdb", ".nsf", ".dbf"),
    ("security", "certificates"): (".pem", ".crt", ".cer", ".der", ".p12", ".pfx", ".p7b", ".p7c"),
    ("security", "keys"): (".key", ".pub", ".ppk", ".pem"),
}

# Name patterns that decide the category before the extension does.
TEMP_NAME_PATTERNS = ("~$*", "*.tmp", "*.temp", "Thumbs.db", ".DS_Store", "desktop.ini")
LOW_VALUE_NAME_PATTERNS = ("*.cache", "*.log", "*.trace")

# Category by MIME prefix when the extension is unknown.
MIME_CATEGORIES = (
    ("text/", "documents"),
    ("image/", "media"),
    ("video/", "media"),
    ("audio/", "media"),
    ("application/pdf", "documents"),
    ("application/zip", "archives"),
    ("application/x-", "executables"),
)

# Scan exclusions.
EXCLUDED_NAMES = ("*.tmp", "*.temp", "~$*", "desktop.ini", "Thumbs.db", ".DS_Store")
EXCLUDED_FOLDERS = ("node_modules", ".git", ".svn", "$RECYCLE.BIN", "System Volume Information", "__pycache__",
                    ".venv", "venv")

# Temporary suffixes, low-value globs.
TEMP_SUFFIXES = (".tmp", ".bak", ".old", ".temp", ".cache")
LOW_VALUE_CACHE_GLOBS = ("**/cache/**", "**/.cache/**", "**/temp/**", "**/Temp/**")
LOW_VALUE_LOG_GLOBS = ("**/*.log", "**/*.trace")

# Image and video extensions of the media split.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".svg", ".ico", ".heic",
                    ".heif", ".raw", ".cr2", ".nef", ".dng", ".arw")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg", ".3gp",
                    ".3g2", ".mts", ".m2ts", ".vob", ".ogv", ".f4v")

# Reorganisation templates per file category.
CATEGORY_TEMPLATES = {
    "documents": "Active/Documents/{subcategory}/{YYYY}",
    "media": "Active/Media/{media_type}/{YYYY-MM}",
    "code": "Active/Projects/{project_name}/src",
    "archives": "Archive/Compressed/{YYYY}",
    "binaries": "System/Binaries/{category}",
}

# Document domains in lookup order
# (domain, types, folder template, name template, fields read from the text, retention years).
DOMAINS = [
    ("financial", ("financial_invoice", "financial_statement", "financial_receipt"),
     "Financial/{doc_type}/{YYYY}/{MM}", "{YYYY-MM-DD}_{vendor}_{invoice_id}_{original}",
     ("invoice_number", "date", "vendor", "amount"), None),
    ("legal", ("legal_contract", "legal_court", "legal_agreement"),
     "Legal/{doc_type}/{YYYY}", "{YYYY-MM-DD}_{party}_{contract_type}_{original}",
     ("contract_date", "parties", "case_number"), 7),
    ("tax", ("tax_document", "tax_form", "tax_return"),
     "Tax/{tax_year}/{form_type}", "{tax_year}_{form_type}_{taxpayer}_{original}",
     ("tax_year", "form_type", "ssn_last4"), 7),
    ("medical", ("medical", "medical_record", "medical_bill"),
     "Medical/{patient}/{YYYY}", "{YYYY-MM-DD}_{provider}_{visit_type}_{original}",
     ("visit_date", "provider", "patient_name"), 10),
    ("hr", ("hr_resume", "hr_application", "hr_benefits"),
     "HR/{doc_type}/{YYYY}", "{YYYY-MM-DD}_{candidate_name}_{position}_{original}",
     ("application_date", "candidate_name", "position"), None),
    ("automotive", ("automotive_technical", "automotive_service"),
     "Automotive/{vehicle_id}/{doc_type}", "{YYYY-MM-DD}_{vehicle}_{service_type}_{original}",
     ("vehicle_model", "vin", "service_date"), None),
    ("realestate", ("realestate_listing", "realestate_contract"),
     "RealEstate/{property_id}/{doc_type}", "{YYYY-MM-DD}_{address}_{property_type}_{original}",
     ("property_address", "listing_date", "price"), None),
    ("business", ("business_marketing", "business_proposal"),
     "Business/{doc_type}/{client}/{YYYY}", "{YYYY-MM-DD}_{client}_{project}_{original}",
     ("client_name", "project_name", "proposal_date"), None),
    ("technical", ("technical_documentation", "technical_manual", "technical_research", "technical_config",
                   "technical_code"),
     "Technical/{doc_type}/{project}", "{YYYY-MM-DD}_{product}_{version}_{original}",
     ("product_name", "version", "date"), None),
    ("product", ("product_manual", "product_catalog"),
     "Products/{manufacturer}/{product_line}", "{manufacturer}_{model}_{manual_type}_{original}",
     ("manufacturer", "model_number", "product_line"), None),
    ("educational", ("educational_material", "educational_guide"),
     "Education/{subject}/{YYYY}", "{YYYY-MM-DD}_{course}_{topic}_{original}",
     ("course_name", "topic", "date"), None),
    ("insurance", ("insurance_document", "insurance_policy", "insurance_claim"),
     "Insurance/{policy_type}/{YYYY}", "{YYYY-MM-DD}_{insurer}_{policy_number}_{original}",
     ("policy_number", "insurer", "policy_date"), 10),
    ("travel", ("travel_document", "travel_itinerary"),
     "Travel/{YYYY}/{destination}", "{YYYY-MM-DD}_{destination}_{booking_ref}_{original}",
     ("destination", "travel_date", "booking_reference"), None),
    ("communication", ("communication_letter", "communication_email"),
     "Communications/{correspondent}/{YYYY}", "{YYYY-MM-DD}_{from}_{to}_{subject}_{original}",
     ("date", "sender", "recipient", "subject"), None),
    ("personal", ("personal_biography", "recipe"),
     "Personal/{doc_type}", "{category}_{title}_{original}", ("title", "category"), None),
    ("scientific", ("scientific_report",),
     "Scientific/{research_area}/{YYYY}", "{YYYY-MM-DD}_{lab}_{experiment_id}_{original}",
     ("experiment_id", "lab_name", "research_area", "date"), None),
]
GENERAL_DOMAIN = ("general", ("general_document", "general_document_short"),
                  "General/{YYYY}/{MM}", "{YYYY-MM-DD}_{original}", (), None)
FALLBACK_DOMAIN = ("fallback", (), "Uncategorized/{file_type}/{YYYY-MM}", "{YYYY-MM-DD}_{original}", (), None)

# Document type -> (domain folder, function folder).
FUNCTION_FOLDERS = {
    "automotive_technical": ("Automotive", "Technical_Manuals"),
    "automotive_service": ("Automotive", "Service_Records"),
    "personal_career": ("Personal", "Career"),
    "personal_journal": ("Personal", "Journals"),
    "personal_essay": ("Personal", "Essays"),
    "personal_career_tool": ("Personal", "Career_Tools"),
    "personal_finance_tool": ("Personal", "Finance_Tools"),
    "financial_invoice": ("Financial", "Invoices"),
    "financial_statement": ("Financial", "Statements"),
    "financial_receipt": ("Financial", "Receipts"),
    "legal_contract": ("Legal", "Contracts"),
    "legal_court": ("Legal", "Court_Documents"),
    "legal_agreement": ("Legal", "Agreements"),
    "tax_document": ("Tax", "Documents"),
    "tax_form": ("Tax", "Forms"),
    "tax_return": ("Tax", "Returns"),
    "medical": ("Medical", "Records"),
    "medical_bill": ("Medical", "Bills"),
    "medical_record": ("Medical", "Records"),
    "hr_resume": ("HR", "Job_Applicant_Resumes"),
    "hr_application": ("HR", "Applications"),
    "hr_benefits": ("HR", "Benefits"),
    "hr_job_listing": ("HR", "Job_Listings"),
    "technical_documentation": ("Technical", "Documentation"),
    "technical_manual": ("Technical", "Manuals"),
    "technical_config": ("Technical", "Configuration"),
    "technical_research": ("Technical", "Research"),
    "technical_code": ("Technical", "Code"),
    "communication_email": ("Communications", "Emails"),
    "communication_letter": ("Communications", "Letters"),
    "business_proposal": ("Business", "Proposals"),
    "business_marketing": ("Business", "Marketing"),
    "realestate_listing": ("Business", "Real_Estate_Listings"),
    "realestate_contract": ("Business", "Real_Estate_Contracts"),
    "screenshot": ("Miscellaneous", "Screenshots"),
    "report": ("Reports", "General"),
    "form": ("Forms", "General"),
    "general_document": ("General", "Documents"),
    "general_document_short": ("General", "Documents"),
    "unknown": ("Review_Required", "Unclassified"),
}

# Cascade presets, (stage, minimum confidence) in order.
CASCADE_PRESETS = {
    "default": [("hosted", 0.85), ("transformer_v2", 0.70), ("forest", 0.60), ("rule_based", 0.0)],
    "fast": [("forest", 0.05), ("rule_based", 0.0)],
    "accurate": [("hosted", 0.90), ("transformer_v2", 0.85), ("forest", 0.75), ("transformer_v1", 0.60),
                 ("rule_based", 0.0)],
    "local_only": [("transformer_v2", 0.70), ("forest", 0.05), ("rule_based", 0.0)],
    "tradeoff_study": [("hosted", 0.0), ("transformer_v2", 0.0), ("forest", 0.0), ("transformer_v1", 0.0),
                       ("rule_based", 0.0)],
}
