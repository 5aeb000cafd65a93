"""What the SQL of the registered queries expects of extensions and types, written out apart from the engine's tables."""

# Asset type, folder and MIME type by extension; folder by type.
IMAGES = ["png", "jpg", "jpeg", "gif", "svg", "webp", "ico"]
FONTS = ["woff", "woff2", "ttf", "otf", "eot"]
TYPE_BY_EXTENSION = {
    "html": "html", "htm": "html", "css": "css", "js": "js", "mjs": "js", "json": "api",
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "svg": "image", "webp": "image", "ico": "image", "bmp": "image",
    "woff": "font", "woff2": "font", "ttf": "font", "otf": "font", "eot": "font",
    "mp4": "media", "webm": "media", "ogg": "media", "mp3": "media", "wav": "media", "pdf": "document", "xml": "document",
}
FOLDER_BY_TYPE = {"css": "css", "js": "js", "image": "img", "font": "fonts", "api": "api", "media": "media", "document": "documents"}
MIME_BY_EXTENSION = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "application/javascript", "mjs": "application/javascript", "json": "application/json",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "ico": "image/x-icon", "bmp": "image/bmp",
    "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf", "eot": "application/vnd.ms-fontobject",
    "mp4": "video/mp4", "webm": "video/webm", "ogg": "audio/ogg", "mp3": "audio/mpeg", "wav": "audio/wav", "pdf": "application/pdf", "xml": "text/xml", "txt": "text/plain",
}
