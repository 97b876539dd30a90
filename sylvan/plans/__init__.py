"""XPath text to syntax trees to DataFrame plans."""
