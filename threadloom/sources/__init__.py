"""Readers that turn export files, session logs, source trees and saved documents into tables, and sinks."""
