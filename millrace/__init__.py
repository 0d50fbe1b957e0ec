"""PySpark-native analytics over session logs, source trees and experiment runs."""
