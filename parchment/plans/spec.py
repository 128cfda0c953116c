"""The vocabulary of findings: categories, details, default actions and weights, and tables that decisions read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Category, detail, default action, weight.
FINDINGS = """
ENCRYPTED EMPTY_PASSWORD strip 10
ENCRYPTED USER_PASSWORD strip 0
ENCRYPTED OWNER_PASSWORD strip 0
ENCRYPTED PASSWORD_REQUIRED reject 0
ENCRYPTED ATTACHMENTS_ONLY strip 10
ENCRYPTED NO_KEY strip 10
ENCRYPTED CERTIFICATE_HANDLER reject 0
ENCRYPTED UNKNOWN_HANDLER reject 0
ENCRYPTED UNKNOWN_CRYPT_FILTER reject 0
ENCRYPTED RC4_40 info 0
ENCRYPTED RC4_128 info 0
ENCRYPTED RC4_OTHER info 0
ENCRYPTED AES_128 info 0
ENCRYPTED AES_256 info 0
ENCRYPTED METADATA_UNENCRYPTED info 0
CORRUPTED UNPARSEABLE reject 0
CORRUPTED TRUNCATED reject 0
CORRUPTED XREF_REBUILT strip 10
CORRUPTED MALFORMED_OBJECT strip 10
CORRUPTED STREAM_LENGTH_WRONG strip 10
CORRUPTED LEADING_BYTES strip 5
CORRUPTED TRAILING_BYTES strip 10
CORRUPTED MISSING_HEADER strip 5
JAVASCRIPT DOCUMENT strip 70
JAVASCRIPT OPEN_ACTION strip 70
JAVASCRIPT PAGE strip 50
JAVASCRIPT FIELD strip 50
JAVASCRIPT ANNOTATION strip 50
JAVASCRIPT LINK strip 50
JAVASCRIPT BOOKMARK strip 50
JAVASCRIPT CHAINED strip 50
JAVASCRIPT RENDITION strip 50
JAVASCRIPT URL strip 50
JAVASCRIPT UNATTACHED strip 50
JAVASCRIPT XFA strip 50
JAVASCRIPT PLUGIN_PASSED info 0
JAVASCRIPT PLUGIN_SCRUBBED info 0
JAVASCRIPT PLUGIN_FAILED strip 0
JAVASCRIPT PLUGIN_REMOVED strip 0
ACTION LAUNCH strip 80
ACTION REMOTE_GOTO strip 60
ACTION EMBEDDED_GOTO strip 60
ACTION SUBMIT_FORM strip 40
ACTION IMPORT_DATA strip 40
ACTION HIDE strip 20
ACTION SET_LAYER_STATE strip 20
ACTION NAMED strip 20
ACTION TRIGGERED strip 20
ACTION UNKNOWN strip 30
LINK SAFE info 0
LINK FILE_URL strip 60
LINK NETWORK_PATH strip 60
LINK DATA_URL strip 60
LINK OTHER_SCHEME strip 30
LINK CREDENTIALS strip 40
LINK IP_HOST strip 40
LINK LOOKALIKE_HOST strip 40
LINK ENCODED_HOST strip 40
LINK TEXT_MISMATCH strip 40
LINK FULL_PAGE strip 20
LINK RELATIVE info 0
LINK PATH_TRICK strip 40
EMBEDDED_FILE NO_PLUGIN strip 30
EMBEDDED_FILE TYPE_MISMATCH info 40
EMBEDDED_FILE PLUGIN_PASSED info 0
EMBEDDED_FILE PLUGIN_SCRUBBED info 0
EMBEDDED_FILE PLUGIN_FAILED strip 30
EMBEDDED_FILE PLUGIN_REMOVED strip 0
EMBEDDED_FILE PORTFOLIO strip 30
MEDIA MOVIE strip 30
MEDIA SOUND strip 30
MEDIA SCREEN strip 30
MEDIA RICH_MEDIA strip 30
MEDIA THREE_D strip 30
MEDIA RENDITION strip 30
MEDIA SLIDESHOW strip 30
ANNOTATION UNKNOWN_SUBTYPE strip 30
FORM FIELDS info 0
FORM XFA info 10
FORM XFA_UNREADABLE strip 40
FORM XFA_PACKET strip 30
FORM XFA_EXECUTE strip 50
FORM XFA_CONNECTION strip 40
FORM XFA_EXTERNAL_OBJECT strip 60
FORM XFA_EXTERNAL_REFERENCE strip 40
FORM XFA_IMAGE strip 20
FORM PLUGIN_PASSED info 0
FORM PLUGIN_SCRUBBED info 0
FORM PLUGIN_FAILED strip 20
FORM PLUGIN_REMOVED strip 0
FORM CALCULATION_ORDER strip 20
SIGNATURE SIGNED info 0
SIGNATURE CERTIFIED info 0
SIGNATURE USAGE_RIGHTS info 0
STRUCTURE INCREMENTAL_UPDATES strip 0
STRUCTURE UNREFERENCED_OBJECTS strip 0
STRUCTURE VERSION_UPGRADED info 0
STRUCTURE SHADOWED_OBJECTS strip 20
STRUCTURE ESCAPED_NAMES info 30
CONTENT JBIG2_IMAGE info 30
CONTENT JPX_IMAGE info 10
CONTENT TYPE3_FONT info 10
METADATA INFO_DICTIONARY info 0
METADATA XMP info 0
METADATA STRIPPED info 0
LIMIT FILE_SIZE reject 0
LIMIT OBJECT_COUNT reject 0
LIMIT DECOMPRESSED_SIZE reject 0
LIMIT NESTING_DEPTH reject 0
LIMIT TIME reject 0
PROCESSING MEMORY_FALLBACK info 0
PROCESSING VERIFICATION_FAILED reject 0
PROCESSING CONTENT_REMOVED strip 20
"""

# Risk bands, by the least score of each.
BANDS = (("CRITICAL", 80), ("HIGH", 50), ("MEDIUM", 25), ("LOW", 1))

# What a finding of each kind means to whoever reads a report; {value} is what the finding shows.
_MEANINGS = """
ENCRYPTED EMPTY_PASSWORD Encrypted, but opens without a password; the copy is not encrypted
ENCRYPTED USER_PASSWORD Opened with the user password; the copy is not encrypted
ENCRYPTED OWNER_PASSWORD Opened with the owner password; the copy is not encrypted
ENCRYPTED PASSWORD_REQUIRED Needs a password that was not given
ENCRYPTED ATTACHMENTS_ONLY Only attached files are encrypted, and their key is not known
ENCRYPTED NO_KEY A stream whose key is not known
ENCRYPTED CERTIFICATE_HANDLER Encrypted for holders of certificates
ENCRYPTED UNKNOWN_HANDLER Encrypted by an unknown security handler
ENCRYPTED UNKNOWN_CRYPT_FILTER Encrypted by an unknown crypt filter
ENCRYPTED RC4_40 Encrypted with 40-bit RC4
ENCRYPTED RC4_128 Encrypted with 128-bit RC4
ENCRYPTED RC4_OTHER Encrypted with RC4 of an unusual key length
ENCRYPTED AES_128 Encrypted with 128-bit AES
ENCRYPTED AES_256 Encrypted with 256-bit AES
ENCRYPTED METADATA_UNENCRYPTED Encrypted but for its metadata
CORRUPTED UNPARSEABLE Can't be read: {value}
CORRUPTED TRUNCATED Ends too early
CORRUPTED XREF_REBUILT The cross-reference table was wrong and has been rebuilt
CORRUPTED MALFORMED_OBJECT An object that is not well formed: {value}
CORRUPTED STREAM_LENGTH_WRONG Streams with a wrong length: {value}
CORRUPTED LEADING_BYTES Bytes before the header: {value}
CORRUPTED TRAILING_BYTES Bytes after the end: {value}
CORRUPTED MISSING_HEADER No header
JAVASCRIPT DOCUMENT A script that runs with the document
JAVASCRIPT OPEN_ACTION A script that runs on opening
JAVASCRIPT PAGE A script that a page runs
JAVASCRIPT FIELD A script that a form field runs
JAVASCRIPT ANNOTATION A script that an annotation runs
JAVASCRIPT LINK A script behind a link
JAVASCRIPT BOOKMARK A script behind a bookmark
JAVASCRIPT CHAINED A script that follows another action
JAVASCRIPT RENDITION A script that comes with media
JAVASCRIPT URL An address that is a script: {value}
JAVASCRIPT UNATTACHED A script that nothing known runs
JAVASCRIPT XFA A script in an XML form: {value}
JAVASCRIPT PLUGIN_PASSED A plugin kept the script
JAVASCRIPT PLUGIN_SCRUBBED A plugin rewrote the script
JAVASCRIPT PLUGIN_FAILED A plugin failed on the script
JAVASCRIPT PLUGIN_REMOVED A plugin removed the script
ACTION LAUNCH Starts a program or opens a file
ACTION REMOTE_GOTO Opens another document
ACTION EMBEDDED_GOTO Opens an embedded document
ACTION SUBMIT_FORM Sends form data
ACTION IMPORT_DATA Reads data from a file
ACTION HIDE Hides or shows annotations
ACTION SET_LAYER_STATE Changes which layers show
ACTION NAMED A named command: {value}
ACTION TRIGGERED An action that an event starts: {value}
ACTION UNKNOWN An unknown action: {value}
LINK SAFE Links to ordinary web addresses, at {value}
LINK FILE_URL A link to a local file: {value}
LINK NETWORK_PATH A link to a network share: {value}
LINK DATA_URL A link that carries its own content: {value}
LINK OTHER_SCHEME A link with an unusual scheme or address: {value}
LINK CREDENTIALS A link with a user name in it: {value}
LINK IP_HOST A link to a bare IP address: {value}
LINK LOOKALIKE_HOST A link to a host that may pose as another: {value}
LINK ENCODED_HOST A link whose host is encoded: {value}
LINK TEXT_MISMATCH A link whose label names another site: {value}
LINK FULL_PAGE A link over most of a page
LINK RELATIVE A link to a file beside the document: {value}
LINK PATH_TRICK A relative link that reads as another one: {value}
EMBEDDED_FILE NO_PLUGIN A file that no plugin takes: {value}
EMBEDDED_FILE TYPE_MISMATCH A file whose name, type and content disagree: {value}
EMBEDDED_FILE PLUGIN_PASSED A plugin kept the file: {value}
EMBEDDED_FILE PLUGIN_SCRUBBED A plugin cleaned the file: {value}
EMBEDDED_FILE PLUGIN_FAILED A plugin failed on the file: {value}
EMBEDDED_FILE PLUGIN_REMOVED A plugin removed the file: {value}
EMBEDDED_FILE PORTFOLIO Shows its attached files as a portfolio
MEDIA MOVIE A movie
MEDIA SOUND A sound
MEDIA SCREEN A screen for media
MEDIA RICH_MEDIA Rich media
MEDIA THREE_D A 3D scene
MEDIA RENDITION Media to be played
MEDIA SLIDESHOW A slide show
ANNOTATION UNKNOWN_SUBTYPE An annotation of an unusual type: {value}
FORM FIELDS Form fields: {value}
FORM XFA An XML form
FORM XFA_UNREADABLE An XML form that can't be read: {value}
FORM XFA_PACKET A part of an XML form with no known use: {value}
FORM XFA_EXECUTE An XML form calls a service: {value}
FORM XFA_CONNECTION An XML form connects to a service: {value}
FORM XFA_EXTERNAL_OBJECT An XML form holds an external object: {value}
FORM XFA_EXTERNAL_REFERENCE An XML form refers to something outside: {value}
FORM XFA_IMAGE A picture of an XML form that no plugin takes: {value}
FORM PLUGIN_PASSED A plugin kept a picture of the form
FORM PLUGIN_SCRUBBED A plugin cleaned a picture of the form
FORM PLUGIN_FAILED A plugin failed on a picture of the form
FORM PLUGIN_REMOVED A plugin removed a picture of the form
FORM CALCULATION_ORDER An order of calculations that are all removed
SIGNATURE SIGNED Signatures: {value}
SIGNATURE CERTIFIED Certified by its author
SIGNATURE USAGE_RIGHTS Usage rights for a reader
STRUCTURE INCREMENTAL_UPDATES Earlier versions in the same file: {value}
STRUCTURE UNREFERENCED_OBJECTS Objects that nothing leads to: {value}
STRUCTURE VERSION_UPGRADED Declares a newer version than its header: {value}
STRUCTURE SHADOWED_OBJECTS Objects that no table lists: {value}
STRUCTURE ESCAPED_NAMES Names with needless escapes: {value}
CONTENT JBIG2_IMAGE JBIG2 pictures: {value}
CONTENT JPX_IMAGE JPEG 2000 pictures: {value}
CONTENT TYPE3_FONT Type 3 fonts: {value}
METADATA INFO_DICTIONARY Document information
METADATA XMP XMP metadata: {value}
METADATA STRIPPED Metadata was removed
LIMIT FILE_SIZE Larger than allowed: {value} bytes
LIMIT OBJECT_COUNT More objects than allowed
LIMIT DECOMPRESSED_SIZE Unpacks to more than allowed
LIMIT NESTING_DEPTH Documents nested deeper than allowed
LIMIT TIME Took longer than allowed
PROCESSING MEMORY_FALLBACK Took more memory than planned: {value}
PROCESSING VERIFICATION_FAILED The copy did not pass its own inspection: {value}
PROCESSING CONTENT_REMOVED Something was removed that no other finding tells of
"""
DESCRIPTIONS = {(c, d): t for c, d, t in (line.split(" ", 2) for line in _MEANINGS.strip().split("\n"))}

ACTIONS = ("info", "strip", "reject")  # by strictness


def finding_rows() -> list[tuple[str, str, str, int]]:
    return [(c, d, a, int(w)) for c, d, a, w in (line.split() for line in FINDINGS.split("\n") if line)]


def finding_spec(spark: SparkSession) -> DataFrame:
    """category, detail, action, weight: a dimension of 113 rows, small enough to broadcast."""
    return spark.createDataFrame(finding_rows(), "category string, detail string, action string, weight int")
