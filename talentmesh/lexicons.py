"""Word lists, lookup tables, constants and patterns.

Everything in this module is a value the results depend on, kept together and in
natural order. No behaviour lives here.
"""

from __future__ import annotations

# --- fixed values: skill lexicon, alphabetical; the position of a skill is its bit ---------------
SKILLS = (
    "accounting", "agile", "android", "angular", "api", "aws", "azure", "business analysis",
    "c#", "c++", "ci/cd", "cloud", "communication", "css", "customer service", "data analysis",
    "data engineering", "devops", "django", "docker", "excel", "fastapi", "figma", "finance",
    "flutter", "git", "go", "graphql", "html", "ios", "java", "javascript", "kotlin",
    "kubernetes", "langchain", "leadership", "linux", "llm", "machine learning", "marketing",
    "mlops", "nlp", "node", "php", "postgresql", "power bi", "product management",
    "project management", "python", "rag", "react", "rest", "ruby", "sales", "scrum", "sql",
    "swift", "tableau", "typescript", "ux",
)

HIGH_VALUE_SKILLS = (
    "aws", "azure", "c#", "ci/cd", "cloud", "data analysis", "data engineering", "devops",
    "django", "docker", "fastapi", "java", "javascript", "kubernetes", "langchain", "linux",
    "llm", "machine learning", "mlops", "nlp", "node", "postgresql", "python", "rag", "react",
    "sql", "typescript",
)

LOW_SIGNAL_SKILLS = (
    "agile", "communication", "excel", "finance", "leadership", "sales", "scrum",
)

# --- fixed values: title terms, alphabetical; the position of a term is its bit ------------------
TITLE_TERMS = (
    "accountant", "ai engineer", "ai/ml engineer", "analyst", "architect", "assistant",
    "consultant", "designer", "developer", "engineer", "machine learning engineer", "manager",
    "marketer", "nurse", "operator", "product manager", "project manager", "sales", "scientist",
    "software engineer", "specialist", "technician",
)

TITLE_CONTEXT_TERMS = (
    "engineer", "developer", "scientist", "architect", "analyst", "assistant", "manager",
    "consultant", "specialist", "technician",
)

SECTION_HEADINGS = (
    "about", "certifications", "contact", "education", "experience", "projects", "skills",
    "summary",
)

# --- fixed values: role families, in order; the first family with a marker in the target wins ----
ROLE_FAMILIES = (
    (
        ("devops", "site reliability", "platform engineer", "cloud engineer"),
        ("devops", "site reliability", "sre", "platform engineer", "platform engineering",
         "cloud engineer", "infrastructure engineer", "release engineer", "build engineer",
         "ci/cd engineer"),
    ),
    (
        ("machine learning", "ml engineer", "artificial intelligence", "ai engineer",
         "data scientist"),
        ("machine learning", "ml engineer", "mlops", "data scientist", "artificial intelligence",
         "ai engineer", "deep learning", "computer vision", "nlp engineer"),
    ),
    (
        ("data engineer", "data analyst", "analytics engineer", "business intelligence"),
        ("data engineer", "data analyst", "data scientist", "analytics engineer",
         "business intelligence", "bi analyst", "etl developer"),
    ),
    (
        ("software engineer", "software developer", "full stack developer", "backend developer",
         "frontend developer", "application engineer", "application developer"),
        ("software engineer", "software developer", "full stack developer",
         "full-stack developer", "backend developer", "back-end developer", "frontend developer",
         "front-end developer", "application engineer", "application developer", "web developer",
         "mobile developer", "programmer"),
    ),
    (
        ("quality assurance", "qa engineer", "test engineer", "software tester"),
        ("quality assurance", "qa engineer", "qa analyst", "software quality", "test engineer",
         "test automation", "automation engineer", "software tester", "sdet"),
    ),
    (
        ("accountant", "accounting"),
        ("accountant", "accounting", "accounts executive", "accounts officer",
         "finance executive", "finance officer", "financial accountant",
         "management accountant", "auditor"),
    ),
    (
        ("registered nurse", "nurse", "nursing"),
        ("registered nurse", "staff nurse", "nurse", "nursing"),
    ),
    (
        ("cybersecurity", "cyber security", "information security", "security analyst"),
        ("cybersecurity", "cyber security", "information security", "security analyst",
         "security engineer", "soc analyst", "penetration tester"),
    ),
    (
        ("human resources", "hr executive", "hr manager", "recruiter"),
        ("human resources", "hr executive", "hr officer", "hr manager", "recruiter",
         "talent acquisition", "people operations"),
    ),
    (
        ("digital marketing", "marketing executive", "marketing manager"),
        ("digital marketing", "marketing executive", "marketing manager", "brand executive",
         "social media", "seo specialist", "content marketing", "growth marketing"),
    ),
)

SENIORITY_TOKENS = ("junior", "senior", "lead")

GENERIC_ROLE_TOKENS = (
    "assistant", "associate", "consultant", "coordinator", "director", "engineer", "executive",
    "intern", "manager", "officer", "specialist", "supervisor", "technician", "trainee",
)

# --- fixed values: countries ---------------------------------------------------------------------
COUNTRY_SYNONYMS = {
    "de": "germany", "gb": "united kingdom", "uk": "united kingdom", "us": "united states",
    "usa": "united states", "lk": "sri lanka", "srilanka": "sri lanka", "sri-lanka": "sri lanka",
}

COUNTRY_PLACES = {
    "sri lanka": ("sri lanka", "colombo", "kandy", "galle", "jaffna", "rajagiriya"),
    "united kingdom": ("united kingdom", "uk", "england", "scotland", "wales",
                       "northern ireland"),
    "united states": ("united states", "usa", "u.s.", "us"),
}

KNOWN_COUNTRIES = (
    "australia", "bahrain", "bangladesh", "canada", "china", "france", "germany", "hong kong",
    "india", "indonesia", "ireland", "italy", "japan", "kuwait", "malaysia", "maldives", "nepal",
    "netherlands", "new zealand", "oman", "pakistan", "philippines", "poland", "qatar",
    "saudi arabia", "singapore", "spain", "thailand", "united arab emirates", "united kingdom",
    "united states", "usa", "uk", "vietnam",
)

GLOBAL_PLACES = ("worldwide", "anywhere", "global", "all regions", "apac", "asia")

AD_API_CODES = {
    "australia": "au", "austria": "at", "belgium": "be", "brazil": "br", "canada": "ca",
    "france": "fr", "germany": "de", "india": "in", "italy": "it", "mexico": "mx",
    "netherlands": "nl", "new zealand": "nz", "poland": "pl", "singapore": "sg",
    "south africa": "za", "spain": "es", "switzerland": "ch", "united kingdom": "gb", "uk": "gb",
    "great britain": "gb", "united states": "us", "usa": "us", "us": "us",
}

EVIDENCE_PLACES = (
    "sri lanka", "colombo", "kandy", "galle", "jaffna", "negombo", "kurunegala", "gampaha",
    "kalutara", "matara", "ratnapura", "batticaloa", "anuradhapura", "sri jayawardenepura",
)

REMOTE_BROAD_TERMS = ("worldwide", "anywhere", "global", "remote", "all regions")
REMOTE_ASIA_TERMS = ("asia", "apac", "oceania")
REMOTE_EUROPE_COUNTRIES = ("germany", "france", "spain", "italy", "netherlands", "poland")

OUTSIDE_TERMS = (
    "bangkok", "india", "uae", "dubai", "egypt", "us only", "usa only", "united states",
    "relocation provided",
)

# --- fixed values: sources -----------------------------------------------------------------------
CURRENT_OPEN_SOURCES = (
    "Adzuna", "Arbeitnow", "CareerFirst", "Career141", "CareerLK", "Crawl4AI Seeds",
    "CSE Careers", "DreamJobs.lk", "FindMyJob.lk", "Gazette.lk", "Government Jobs",
    "GovernmentJobs.lk", "GovernmentVacancies.lk", "Hire.lk", "Himalayas", "Ikman Jobs",
    "Inseeks", "ITPro.lk", "JobEka.lk", "JobFactory.lk", "Jobber.lk", "JobPal", "Jobup.lk",
    "job.govdoc.lk", "LankaJob.lk", "LankaQualityJobs.com", "LinkedIn Public", "MYJOBS.LK",
    "Observer Jobs", "Recruiter.lk", "Recruitme.lk", "Remote OK", "Remotive", "RemoteRocketship",
    "SLBFE Job Bank", "TimesJobs.lk", "topjobs.lk", "We Work Remotely", "XpressJobs",
    "IFS Sri Lanka Careers", "Infor Sri Lanka Careers", "Bistec Global Careers", "3CS Careers",
    "Rootcode Careers", "Pearson Sri Lanka Careers", "MillenniumIT ESP Careers",
    "John Keells IT Careers", "Deloitte Sri Lanka Technology Careers",
    "Acumatica Sri Lanka Careers",
)

DISCOVERY_SOURCES = (
    "DuckDuckGo Discovery", "Google Custom Search", "SerpAPI Google", "Crawl4AI",
    "Crawl4AI Seeds",
)

# --- fixed values: closed postings ---------------------------------------------------------------
CLOSED_JOB_PHRASES = (
    "applications are closed", "application deadline has passed", "job expired",
    "job has expired", "job is no longer available", "no longer accepting applications",
    "position filled", "position has been filled", "vacancy has expired",
)

CLOSED_PAGE_PHRASES = (
    "applications are closed", "application deadline has passed", "job has expired",
    "job is expired", "job is no longer available", "no longer accepting applications",
    "position has been filled", "position is filled", "this vacancy has closed",
    "vacancy has expired",
)

# --- fixed values: seniority and scoring vocabulary ----------------------------------------------
ENTRY_TITLE_TERMS = ("intern", "trainee", "graduate", "junior", "entry level", "entry-level")
UNDERLEVEL_PATTERN = r"\b(?:intern(?:ship)?|trainee|graduate trainee|apprentice)\b"
SENIORITY_MINIMUMS = (
    (r"\b(?:vice president|vp|director|head of|chief)\b", 7.0),
    (r"\b(?:principal|staff|architect|manager)\b", 5.0),
    (r"\b(?:lead|senior|sr\.?)(?:\s|$)", 3.0),
)
YEARS_PATTERNS = (
    r"(?:minimum|min\.?|at least|requires?|required|with)\s+(\d+(?:\.\d+)?)\+?\s*(?:-|to)?\s*\d*\s*years?",
    r"(\d+(?:\.\d+)?)\+?\s*(?:-|to)?\s*\d*\s*years?\s+(?:of\s+)?(?:relevant\s+|professional\s+)?experience",
)
SENIOR_TITLE_WORDS = ("senior", "lead", "principal", "staff", "manager", "director")
SENIOR_CV_WORDS = ("senior", "lead", "manager", "principal", "5 years", "6 years", "7 years")
ELIGIBILITY_WORDS = ("visa", "work authorization", "security clearance", "native")

AI_PROFILE_TITLES = ("ai/ml engineer", "ai engineer", "machine learning engineer")
AI_PROFILE_SKILLS = ("machine learning", "llm", "nlp", "rag", "mlops", "langchain")
AI_TARGET_WORDS = ("ai", "machine learning", "ml", "llm")
AI_EXCLUDED_WORDS = (
    "sales", "copywriter", "writer", "customer", "office assistant", "designer", "video editor",
)
AI_EXACT_ROLES = (
    "ai engineer", "ai/ml engineer", "ml engineer", "machine learning engineer", "llm engineer",
    "rag engineer", "nlp engineer", "computer vision engineer", "ai architect",
)
AI_SCIENTIST_ROLES = ("data scientist", "applied scientist")
AI_POSITION_WORDS = (
    "ai", "artificial intelligence", "machine learning", "ml", "llm", "data scientist",
)
AI_TITLE_WORDS = (
    "ai engineer", "ai/ml", "artificial intelligence", "computer vision", "data science",
    "data scientist", "deep learning", "generative ai", "llm", "machine learning", "ml engineer",
    "mlops", "nlp",
)
AI_TITLE_ROLE_PATTERN = r"\b(engineer|consultant|developer|architect|lead|intern)\b"
AI_HAYSTACK_TERMS = (
    "machine learning", "artificial intelligence", " ai ", " ml ", "llm", "rag", "mlops", "nlp",
)
TECHNICAL_ROLE_TERMS = ("engineer", "scientist", "developer", "architect")
JOB_TEXT_WORDS = ("job", "jobs", "career", "careers", "vacancy", "apply", "linkedin")

CONCERN_ELIGIBILITY = "Check eligibility requirements in the job description."
CONCERN_SENIORITY_YEARS = "Seniority may exceed the supplied experience years."
CONCERN_SENIORITY_REVIEW = "Seniority may need manual review."
CONCERN_UNDERLEVEL = (
    "Internship or trainee seniority is below the supplied experience years."
)

ROUTER_PROVIDER = "deterministic-confidence-router"
ROUTER_MODEL = "v1"
ROUTER_REJECT_REASON = (
    "Deterministic rejection: required experience exceeds candidate experience"
)
ROUTER_ACCEPT_REASON = (
    "Deterministic acceptance: high-confidence title and CV evidence"
)

# --- fixed values: IT role terms -----------------------------------------------------------------
IT_ROLE_TERMS = (
    "software", "developer", "programmer", "frontend", "front end", "backend", "back end",
    "full stack", "fullstack", "web engineer", "mobile developer", "android", "ios developer",
    "flutter", "react", "java developer", "python developer", "net developer", "devops",
    "site reliability", "sre", "cloud engineer", "cloud architect", "platform engineer",
    "data engineer", "data scientist", "data analyst", "database", "dba", "machine learning",
    "ml engineer", "ai engineer", "ai/ml", "artificial intelligence", "generative ai",
    "llm engineer", "nlp", "computer vision", "mlops", "cyber security", "cybersecurity",
    "information security", "security engineer", "network engineer", "systems engineer",
    "system administrator", "it support", "help desk", "qa engineer", "quality assurance",
    "test automation", "automation engineer", "solutions architect", "technical architect",
    "ui developer", "ux engineer", "business intelligence", "power bi", "sap consultant",
    "erp consultant", "technical lead", "engineering manager", "product engineer",
    "scrum master", "technical project manager", "information technology", "it manager",
)

# --- fixed values: search phrases ----------------------------------------------------------------
SEARCH_SKILL_PRIORITY = (
    "machine learning", "python", "llm", "nlp", "rag", "mlops", "langchain", "data engineering",
    "fastapi", "postgresql", "docker", "kubernetes", "aws", "azure", "react", "typescript",
    "javascript", "sql",
)
SEARCH_SKIPPED_SKILLS = ("api", "git", "html", "css")
SEARCH_TITLE_WORDS = ("ai", "machine", "software", "data", "engineer", "developer")
AI_QUERY_TERMS = (
    "machine learning engineer", "ai engineer", "ai/ml engineer", "ml engineer",
    "data scientist", "llm engineer", "rag engineer", "mlops engineer",
    "computer vision engineer", "nlp engineer", "python machine learning",
)
SEARCH_MODIFIERS = (
    "certified", "chartered", "experienced", "graduate", "junior", "lead", "licensed",
    "principal", "qualified", "registered", "senior", "staff",
)
SEARCH_DOMAINS = (
    "topjobs.lk", "xpress.jobs", "ikman.lk", "jobber.lk", "jobfactory.lk", "dreamjobs.lk",
    "jobeka.lk", "findmyjob.lk", "lk.linkedin.com/jobs", "career141.com", "careerfirst.lk",
    "observerjobs.lk", "timesjobs.lk", "governmentjobs.lk", "governmentvacancies.lk",
    "gazette.lk", "job.govdoc.lk", "slbfe.lk", "lankaqualityjobs.com", "recruitme.lk",
    "jobpal.lk", "jobup.lk", "myjobs.lk", "itpro.lk", "careerlk.com", "hire.lk", "recruiter.lk",
    "lankajob.lk", "inseeks.com", "jobs.observer.lk", "cse.lk", "gov.lk",
)
DRAFT_SKILL_PRIORITY = (
    "machine learning", "python", "llm", "nlp", "rag", "mlops", "langchain", "data engineering",
    "data analysis", "fastapi", "postgresql", "docker", "kubernetes", "aws", "azure", "ci/cd",
    "cloud", "react", "typescript", "javascript", "sql",
)

# --- fixed values: link and page vocabulary ------------------------------------------------------
TRACKING_KEYS_VACANCY = ("dclid", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid")
TRACKING_KEYS_CRAWL = ("fbclid", "gclid", "mc_cid", "mc_eid")
JOB_LINK_WORDS = (
    "job", "career", "vacanc", "position", "recruit", "opening", "opportunit", "apply",
)
GENERIC_LISTING_TITLES = (
    "jobs", "browse jobs", "all jobs", "latest jobs", "local jobs", "find jobs", "find a job",
    "job vacancies", "vacancies", "careers", "career opportunities", "job search", "search",
    "search jobs", "search results", "view all", "see live jobs", "more jobs",
    "current openings", "open positions",
)
GENERIC_LISTING_PREFIXES = (
    "browse all", "view all", "search jobs", "find jobs", "all vacancies",
)
LISTING_HEADING_PHRASES = ("job listings", "job search results", "browse vacancies")
DETAIL_ID_KEYS = ("job_id", "jobid", "vacancy_id", "vacancyid", "jid", "posting_id")
LISTING_KEYS = (
    "q", "query", "s", "search", "keyword", "keywords", "search_keywords", "search_query",
    "category", "sector", "industry", "department", "location", "page", "paged", "pageno",
    "start", "offset",
)
SEARCH_KEYS = ("q", "query", "s", "search", "keyword", "keywords", "search_keywords")
PAGING_KEYS = ("page", "paged", "pageno", "start", "offset")
LISTING_LEAVES = (
    "jobs", "job-search", "search-jobs", "careers", "vacancies", "openings", "positions",
    "local-jobs", "job-listings", "all-jobs", "latest-jobs",
)
LISTING_SEGMENTS = (
    "category", "categories", "job-category", "job-categories", "sector", "sectors", "industry",
    "industries", "department", "departments", "browse", "search", "job-search", "tags", "tag",
)
LISTING_ROOTS = ("jobs", "careers", "vacancies", "openings")
NON_JOB_SEGMENTS = (
    "account", "about", "auth", "blog", "contact", "employers", "faq", "help", "login", "news",
    "privacy", "register", "redirect", "resume", "share", "signin", "signup", "social", "terms",
    "training",
)
DOCUMENT_SUFFIXES = (".html", ".htm", ".php", ".aspx")
PAGER_LABELS = ("next", "previous", "prev", "older", "newer", "›", "»", "→")
NAVIGATION_PHRASES = (
    "job categories", "jobs by category", "jobs by sector", "jobs by industry", "browse by",
    "view more jobs", "load more jobs",
)
JOB_CATEGORY_TERMS = (
    "accounting", "administration", "agriculture", "apparel", "automotive", "banking", "beauty",
    "construction", "customer service", "education", "engineering", "finance", "healthcare",
    "hospitality", "human resources", "information technology", "legal", "logistics",
    "manufacturing", "marketing", "medical", "retail", "sales", "security", "supply chain",
    "technology", "tourism",
)
ROLE_TITLE_WORDS = (
    "engineer", "developer", "manager", "analyst", "officer", "executive", "accountant",
    "assistant", "specialist", "consultant", "architect", "designer", "coordinator",
    "administrator", "technician", "intern", "director", "scientist", "teacher", "lecturer",
    "nurse", "doctor", "cashier", "clerk", "supervisor", "mechanic", "electrician", "operator",
)
NAVIGATION_FAMILIES = (
    (("accountant", "accounting", "accounts", "auditor", "audit"),
     ("accounting", "accountancy", "finance", "audit", "tax")),
    (("nurse", "nursing", "doctor", "clinical", "caregiver"),
     ("healthcare", "medical", "hospital", "clinical", "nursing", "nurse", "care")),
    (("developer", "software", "programmer", "devops", "cloud"),
     ("technology", "digital", "software", "it", "engineering")),
    (("teacher", "lecturer", "academic", "trainer"),
     ("education", "training", "academic", "teaching")),
    (("sales", "marketing", "brand"),
     ("sales", "marketing", "retail", "business development")),
    (("chef", "hotel", "restaurant", "hospitality"),
     ("hospitality", "tourism", "hotel", "food")),
    (("driver", "warehouse", "logistics", "procurement"),
     ("transport", "logistics", "supply chain", "warehouse")),
    (("lawyer", "legal", "counsel"), ("legal", "law")),
    (("hr", "recruiter", "recruitment"),
     ("human resources", "recruitment", "administration")),
)
PLAIN_LINK_TITLES = ("view job", "view details", "details", "apply")
SEARCH_FIELD_NAMES = (
    "q", "s", "query", "search", "keyword", "keywords", "search_keywords", "search_query",
    "job_title", "position",
)
DETAIL_SIGNALS = (
    "apply now", "apply for", "how to apply", "job description", "responsibilities",
    "requirements", "qualifications", "employment type", "closing date", "date posted",
    "valid through", "experience required", "key duties",
)
LOCATION_FIELD_MARKERS = ("joblocation", "job_location", "geo.placename", "location")
PUBLISHED_FIELD_MARKERS = (
    "dateposted", "datepublished", "publishdate", "article:published_time",
)
GENERIC_ADVERT_PREFIXES = (
    "please refer the full details of the job posting",
    "please refer the vacancy",
    "please refer the advert",
)

# --- fixed values: contacts and e-mail -----------------------------------------------------------
HR_WORDS = (
    "recruiter", "recruitment", "talent acquisition", "talent partner", "human resources",
    "people operations", "people partner", "hr ", " hr",
)
RECRUITING_PREFIXES = (
    "careers", "career", "cv", "hr", "jobs", "job", "people", "recruit", "recruiter",
    "recruiters", "recruiting", "recruitment", "talent", "work",
)
PLACEHOLDER_EMAIL_WORDS = ("example.com", "domain.com", "email.com", "yourname", "name@")
HARVEST_PREFIXES = (
    "career", "careers", "cv", "hello", "hr", "info", "job", "jobs", "people", "recruit",
    "recruiting", "recruitment", "talent", "work",
)
HARVEST_SKIPPED_DOMAINS = (
    "example.com", "domain.com", "email.com", "sentry.io", "wixpress.com", "schema.org",
    "cloudflare.com",
)
HARVEST_JUNK_WORDS = (
    "yourname", "name@", "user@", "test@", ".png", ".jpg", ".webp",
)
AGGREGATOR_HOSTS = (
    "linkedin.com", "topjobs.lk", "itpro.lk", "himalayas.app", "weworkremotely.com",
    "recruit.net", "hire.lk", "drjobpro.com", "crossover.com",
)
CONTACT_LINK_WORDS = (
    "apply", "career", "contact", "job", "vacan", "about", "team", "join", "recruit",
)
EMAIL_PATTERN = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
CONTACT_PRIORITY = {"public_email": 0, "public_linkedin_result": 1, "manual_review": 2}

ANONYMOUS_COMPANIES = (
    "anonymous", "company confidential", "confidential", "not disclosed", "not specified",
    "unknown",
)

EVIDENCE_GAP = "\n...[middle characters omitted; original length recorded]...\n"
