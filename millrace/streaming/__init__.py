"""No operator of this engine works on streams; the package is kept for those that may."""
