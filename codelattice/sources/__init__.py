"""Reading source trees and tables, and writing results."""
