"""vatloom.functions"""
