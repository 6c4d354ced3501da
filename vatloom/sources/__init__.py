"""vatloom.sources"""
